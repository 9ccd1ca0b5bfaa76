"""Encoding into vocabulary pieces along the best path, and decoding; giant texts by a max-plus scan over chunks."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.llm.common import saved

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a text's own U+2581, which must not be taken for a space. It is no valid character of a text.
OWN = "\udc81"
LOW = -np.inf


class Pieces:
    """A piece vocabulary and the best segmentation of a text: the path of highest total score.

    The scores are those of the vocabulary file; pieces without a regular score (below -1e8, such as a lone space)
    come just below all others. A character that no piece covers becomes its UTF-8 bytes, at a score below all others. Of equal paths the one with
    the longer last piece wins. All scores are whole numbers here, so sums are exact in any order.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.score, self.id, self.bytes = {}, {}, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                self.id[self.bytes[-1]] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(SPACE, " ").encode())
                self.score[piece], self.id[piece] = float(sp.get_score(i)), i
        least = min(s for s in self.score.values() if s > -1e8)
        self.score = {p: s if s > -1e8 else least - 1 for p, s in self.score.items()}
        self.unknown = least - 10
        self.width = max(map(len, self.score))
        lengths: dict[str, set] = {}
        for p in self.score:
            if len(p) > 2:
                lengths.setdefault(p[:3], set()).add(len(p))
        #: By the first three characters, the lengths of the longer pieces that begin so.
        self.lengths = {k: sorted(v) for k, v in lengths.items()}
        self._plant()
        #: No piece goes from another character into a space: every path has a node before each run of spaces.
        self.parted = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.parted else "(?s).+")
        #: Units met lately, and those met before them: memory stays bounded, and what is frequent stays known.
        self.known: dict[str, tuple[bytes, float]] = {}
        self.older: dict[str, tuple[bytes, float]] = {}

    def _plant(self):
        """The pieces as a tree: `step` holds node * 2**21 + character in ascending order, `into` the node it leads to,
        `worth` and `piece` the score and id of the piece that ends in a node (none: LOW)."""
        nodes: dict[str, int] = {"": 0}
        for text in sorted(self.score):
            for end in range(1, len(text) + 1):
                nodes.setdefault(text[:end], len(nodes))
        self.worth, self.piece = np.full(len(nodes), LOW), np.zeros(len(nodes), np.int32)
        for text, s in self.score.items():
            self.worth[nodes[text]], self.piece[nodes[text]] = s, self.id[text]
        step = np.array([nodes[t[:-1]] << 21 | ord(t[-1]) for t in nodes if t], np.int64)
        order = np.argsort(step)
        self.step, self.into = step[order], np.arange(1, len(nodes))[order]

    def edges(self, text: str, at: int):
        """(end, score) of what can start here."""
        one = text[at]
        yield at + 1, self.score.get(one, self.unknown)
        get = self.score.get
        for n in (2, *self.lengths.get(text[at : at + 3], ())):
            if at + n <= len(text) and (s := get(text[at : at + n])) is not None:
                yield at + n, s

    def best(self, unit: str) -> tuple[tuple[int, ...], float]:
        """Ids and score of the best path through a unit."""
        n, get, lengths, unknown = len(unit), self.score.get, self.lengths.get, self.unknown
        score, origin = [0.0] + [LOW] * n, [0] * (n + 1)
        for at in range(n):
            base = score[at]
            s = base + get(unit[at], unknown)
            if s > score[at + 1]:
                score[at + 1], origin[at + 1] = s, at
            if at + 2 <= n and (s := get(unit[at : at + 2])) is not None and base + s > score[at + 2]:
                score[at + 2], origin[at + 2] = base + s, at
            for m in lengths(unit[at : at + 3], ()):
                end = at + m
                if end > n:
                    break
                s = get(unit[at:end])
                if s is not None and base + s > score[end]:
                    score[end], origin[end] = base + s, at
        ids, end = [], n
        while end:
            piece = unit[origin[end] : end]
            if piece in self.id:
                ids.append(self.id[piece])
            else:
                ids.extend(self.id[bytes([b])] for b in reversed((SPACE if piece == OWN else piece).encode("utf-8", "surrogatepass")))
            end = origin[end]
        return tuple(reversed(ids)), score[-1]

    def _best_of_many(self, units: list[str]) -> list[tuple[bytes, float] | None]:
        """What best() gives for each unit (ids as int32), all at once; None where a character has no piece of its own."""
        size = np.array([len(u) for u in units])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        start = np.cumsum(size) - size
        code = np.frombuffer("".join(units[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        stop = np.repeat(start + size, size)
        w = self.width
        # By last character and length (the longest first): score and id of the piece that ends here.
        gain, piece = np.full((len(code), w), LOW), np.zeros((len(code), w), np.int32)
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        for n in range(1, w + 1):
            key = node << 21 | code[at + n - 1]
            found = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
            hit = self.step[found] == key
            at, node = at[hit], self.into[found[hit]]
            gain[at + n - 1, w - n], piece[at + n - 1, w - n] = self.worth[node], self.piece[node]
            more = at + n < stop[at]
            at, node = at[more], node[more]
        covered = np.logical_and.reduceat(gain[:, w - 1] > LOW, start)
        score, choice = np.full((len(units), w + size[0]), LOW), np.zeros((len(units), size[0] + 1), np.int64)
        score[:, w - 1] = 0
        for end in range(1, size[0] + 1):
            k = np.searchsorted(-size, -end, "right")  # units that long come first
            sums = score[:k, end - 1 : end - 1 + w] + gain[start[:k] + end - 1]
            choice[:k, end] = sums.argmax(axis=1)
            score[:k, end - 1 + w] = sums[np.arange(k), choice[:k, end]]
        # Backwards, one piece of every unfinished unit at a time.
        left, row, count = size.copy(), np.flatnonzero(covered), np.zeros(len(units), np.int64)
        ids = np.zeros((len(units), size[0]), np.int32)
        while len(row):
            c = choice[row, left[row]]
            count[row] += 1
            ids[row, size[0] - count[row]] = piece[start[row] + left[row] - 1, c]
            left[row] -= w - c
            row = row[left[row] > 0]
        out: list = [None] * len(units)
        raw, width, total = ids.tobytes(), 4 * size[0], score[np.arange(len(units)), size + w - 1].tolist()
        for i, (to, n, good) in enumerate(zip(order.tolist(), count.tolist(), covered.tolist(), strict=True)):
            if good:
                out[to] = raw[(i + 1) * width - 4 * n : (i + 1) * width], total[i]
        return out

    def learn(self, units: list[str]) -> dict[str, tuple[bytes, float]]:
        """Ids (int32) and score of at least all these units."""
        if len(self.known) >= 250_000:
            self.older, self.known = self.known, {}
        known, older, new, long = self.known, self.older, [], {}
        for u in set(units).difference(known):
            if u in older:
                known[u] = older[u]
            else:
                new.append(u)
        short = [u for u in new if len(u) < 64]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            known.update(zip(part, self._best_of_many(part), strict=True))
        for u in new:
            if len(u) >= 64 or known[u] is None:
                ids, s = self.best(u)
                (known if len(u) < 64 else long)[u] = np.array(ids, np.int32).tobytes(), s
        return known | long if long else known

    def paths(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of the best path through each of these texts."""
        units = [self.unit.findall(t) for t in texts]
        known = self.learn([u for x in units for u in x])
        return [np.frombuffer(b"".join([known[u][0] for u in x]), np.int32) for x in units]

    def path(self, marked: str) -> list[int]:
        return self.paths([marked])[0].tolist()

    def decode(self, ids) -> bytes:
        """UTF-8 of the pieces, with the space before the first."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def transfer(self, text: str, border: int) -> np.ndarray:
        """Max-plus matrix of a chunk: row i, column j is the best score from the node i characters before the chunk's
        border to the node j characters before its end, with no node of the path between the first and the border."""
        w = self.width
        node: dict[int, np.ndarray] = {}
        for i in range(min(w, border + 1)):
            node[border - i] = np.full(w, LOW)
            node[border - i][i] = 0
        breaks = [m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", text[border:])] if self.parted else []
        first, last = (border + breaks[0], border + breaks[-1]) if breaks else (len(text), len(text))
        self._forward(text, node, max(border - w + 1, 0), first, border)
        if breaks:
            units = self.unit.findall(text[first:last])
            known = self.learn(units)
            middle = sum(known[u][1] for u in units)
            node[last] = node[first] + middle
            self._forward(text, node, last, len(text), border)
        none = np.full(w, LOW)
        return np.column_stack([node.get(len(text) - j, none) if len(text) - j >= (last if breaks else border + 1) else none for j in range(w)])

    def _forward(self, text, node, start, stop, border):
        for at in range(start, stop):
            if at in node:
                for end, s in self.edges(text, at):
                    if border < end <= stop:
                        new = node[at] + s
                        node[end] = np.maximum(node[end], new) if end in node else new


@lru_cache(maxsize=4)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def marked(text: str) -> str:
    """The text as pieces see it: spaces shown, one more in front."""
    return SPACE + text.replace(SPACE, OWN).replace(" ", SPACE) if text else ""


def _utf8(shown: str) -> bytes:
    return shown.replace(SPACE, " ").replace(OWN, SPACE).encode("utf-8", "surrogatepass")


def _lists(rows: list) -> pa.Array:
    lengths = [len(r) for r in rows]
    flat = np.concatenate([*rows, np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


def _whole(model: bytes):
    def run(batches):
        p = _pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                t = batch.slice(at, 128)
                shown = [marked(x or "") for x in t.column("text").to_pylist()]
                ids = p.paths(shown)
                good = [p.decode(i) == _utf8(x) for i, x in zip(ids, shown, strict=True)]
                yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), _lists(ids), pa.array(good)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return run


def _chunks(width: int, size: int):
    def run(batches):
        for batch in batches:
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                shown = marked(text)
                for k, at in enumerate(range(0, len(shown), size)):
                    start = max(at - width, 0)
                    body = _utf8_shown(shown[start : at + size])
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "row": [row], "k": pa.array([k], pa.int32()), "border": pa.array([at - start], pa.int32()), "shown": pa.array([body], pa.binary())})

    return run


def _utf8_shown(shown: str) -> bytes:
    return shown.encode("utf-8", "surrogatepass")


def _transfers(model: bytes):
    def run(batches):
        p = _pieces(model)
        for batch in batches:
            m = [p.transfer(s.decode("utf-8", "surrogatepass"), b).ravel() for s, b in zip(batch.column("shown").to_pylist(), batch.column("border").to_pylist(), strict=True)]
            if m:
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * p.width**2), pa.array(np.concatenate(m)))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), flat], ["row", "k", "matrix"])

    return run


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    return np.stack([(a[:, i, :, None] + b).max(axis=1) for i in range(a.shape[1])], axis=1)


def borders(m: np.ndarray) -> np.ndarray:
    """How many characters before each chunk's border (the last entry: the text's end) the best path has its last node.

    A scan by doubling combines the matrices: after its rounds entry k holds the product of all up to k. The path
    itself is then read off from the end, one row of scores at a time.
    """
    total, shift = m.copy(), 1
    while shift < len(m):
        total[shift:] = product(total[:-shift], total[shift:])
        shift *= 2
    reach = np.concatenate([np.where(np.arange(m.shape[1]) == 0, 0.0, LOW)[None, :], total[:, 0, :]])
    out = np.zeros(len(m) + 1, np.int64)
    for k in range(len(m) - 1, -1, -1):
        s = reach[k] + m[k][:, out[k + 1]]
        out[k] = len(s) - 1 - int(np.argmax(s[::-1]))
    return out


def _scan(width: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        m = t.column("matrix").combine_chunks().flatten().to_numpy().reshape(-1, width, width)
        at = borders(m)
        return pa.table({"row": t.column("row"), "k": t.column("k"), "before": pa.array(at[:-1].astype(np.int32)), "short": pa.array(at[1:].astype(np.int32))})

    return run


def _backtraced(model: bytes):
    def run(batches):
        p = _pieces(model)
        for batch in batches:
            texts = []
            for shown, border, before, short in zip(*(batch.column(c).to_pylist() for c in ("shown", "border", "before", "short")), strict=True):
                text = shown.decode("utf-8", "surrogatepass")
                texts.append(text[border - before : len(text) - short])
            ids = [i for at in range(0, len(texts), 128) for i in p.paths(texts[at : at + 128])]
            good = [p.decode(i) == _utf8(x) for i, x in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("k"), _lists(ids), pa.array(good, pa.bool_())], ["row", "doc_id", "k", "ids", "good"])

    return run


def encode_documents(docs: DataFrame, model_path: str = MODEL, giant: int = 65_536, chunk: int = 16_384) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip of every row of docs (doc_id, text; other columns are ignored).

    The ids of the best path (see Pieces). round_trip says whether decoding gives the text back byte for byte. A null
    or empty text has no tokens. Repeated rows are encoded each. Texts of more than `giant` characters are cut into
    chunks of `chunk`; each chunk gives a max-plus matrix from the nodes before its border to those before its end,
    a text's matrices are combined by an associative scan, which tells where the best path crosses each border, and
    every chunk is then segmented by itself between its two crossings. The vocabulary file is read on the driver
    and sent along; executors need no such file.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    width = _pieces(model).width
    size = F.coalesce(F.char_length("text"), F.lit(0))
    kind = "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean"
    plain = docs.select("doc_id", "text").where(size <= giant).mapInArrow(_whole(model), kind)
    rows = docs.select("doc_id", "text").where(size > giant).withColumn("row", F.monotonically_increasing_id())
    chunks = saved(rows.mapInArrow(_chunks(width, chunk), "doc_id long, row long, k int, border int, shown binary"), "chunks")
    matrices = chunks.select("row", "k", "border", "shown").mapInArrow(_transfers(model), "row long, k int, matrix array<double>")
    crossings = matrices.groupBy("row").applyInArrow(_scan(width), "row long, k int, before int, short int")
    parts = chunks.join(crossings, ["row", "k"]).mapInArrow(_backtraced(model), "row long, doc_id long, k int, ids array<int>, good boolean")
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.every("good").alias("round_trip"))
    ids = F.flatten("parts.ids")
    return plain.unionByName(whole.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), ids.alias("token_ids"), "round_trip"))


def decode_documents(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text of every row of tokens (doc_id, token_ids)."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        p = _pieces(model)
        for batch in batches:
            out = [None if x is None else p.decode(x)[1:].decode("utf-8", "replace") for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")
