"""Byte-level BPE by distinct words: each word of the corpus is encoded once, wherever it stands, and decoding."""

from __future__ import annotations

import base64
import heapq
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.llm.common import saved_in_buckets

STRETCH = 1 << 16


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks by token bytes, and the pattern that cuts a text into words; read on the driver and sent along."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return ranks, pattern or public_tokenizers.PATTERN


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the neighbours whose union has the least rank are joined first, the leftmost of equal ones."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # by a part's first byte: its end, the part before it
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if middle <= i or middle >= stop or end[middle] != stop:
            continue  # one of the two has been joined otherwise
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


def stretches(text: str, size: int = STRETCH):
    """Parts of a text that are cut into words apart as they would be together: no word goes on from another
    character into white space, and what follows a cut is looked at by nothing before it."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


_CUT = regex.compile(r"\S(?=\s)")


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers, byte by byte of their order: the high bytes of frequent words' numbers are mostly zero."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _words(pattern: str, block_size: int):
    """Blocks of documents: their distinct words, the most frequent first, and which of them stand at the documents' positions."""

    def run(batches):
        find = regex.compile(pattern).findall
        number: dict[str, int] = {}
        ids, counts, numbers, size, block, part, id_type = [], [], [], 0, 0, 0, pa.int64()

        def flush():
            every = np.concatenate([*numbers, np.zeros(0, np.uint32)])
            order = np.argsort(-np.bincount(every, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            words = pa.array(list(number), pa.string()).take(pa.array(order, pa.int64()))
            row = [pa.array([part << 32 | block]), pa.array([len(number)]), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (words, pa.array(ids, id_type), pa.array(counts, pa.int64()))),
                   pa.array([_packed(rank[every])], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["block", "n_words", "words", "doc_ids", "counts", "numbers"])

        for batch in batches:
            if batch.num_rows:
                part, id_type = batch.column("part")[0].as_py(), batch.column("doc_id").type
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py() or ""
                total = 0
                for stretch in stretches(text) if text else ():
                    words = find(stretch)
                    for w in set(words).difference(number):
                        number[w] = len(number)
                    numbers.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                    total += len(words)
                ids.append(batch.column("doc_id")[row].as_py())
                counts.append(total)
                size += len(text)
                if size >= block_size:
                    yield flush()
                    number, block, size = {}, block + 1, 0
                    ids, counts, numbers = [], [], []
        if ids:
            yield flush()

    return run


def _places(words: pa.Array) -> np.ndarray:
    """Places of words, 0 to 2**32 - 1, by their UTF-8."""
    return np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.uint64, len(words))


def _dealt(groups: int):
    """A block's words by group: neighbouring places form a group. Lengths and letters are packed, in the order of places."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column("words")[row].values
                place = _places(words)
                order = np.argsort(place, kind="stable")
                group = place[order] * groups >> 32
                words = words.take(pa.array(order)).cast(pa.large_binary())
                ends = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
                letters = words.buffers()[2].to_pybytes()
                first = np.flatnonzero(np.diff(group.astype(np.int64), prepend=-1))
                bounds = [*first.tolist(), len(words)]
                sizes = [_packed(np.diff(ends[i : j + 1])) for i, j in zip(bounds, bounds[1:], strict=False)]
                text = [squeeze(letters[ends[i] : ends[j]]) for i, j in zip(bounds, bounds[1:], strict=False)]
                block = np.full(len(first), batch.column("block")[row].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(group[first].astype(np.int64)), pa.array(sizes, pa.binary()), pa.array(text, pa.binary())], ["block", "group", "sizes", "letters"])

    return run


def _encoded(ranks: dict[bytes, int]):
    """Rows come in the order of their group, and all of a word are in one group: a word is encoded when it is met first."""

    def run(batches):
        open_up = zstandard.ZstdDecompressor().decompress
        group, known = None, {}
        for batch in batches:
            many, out = [], []
            for mine, sizes, letters in zip(*(batch.column(c).to_pylist() for c in ("group", "sizes", "letters")), strict=True):
                if mine != group:
                    group, known = mine, {}
                ends = np.cumsum(_unpacked(sizes)).tolist()
                letters = open_up(letters)
                words = [letters[i:j] for i, j in zip([0, *ends], ends, strict=False)]
                for w in words:
                    if w not in known:
                        known[w] = merged(w, ranks)
                ids = [known[w] for w in words]
                many.append(_packed(np.fromiter(map(len, ids), np.uint32, len(ids))))
                out.append(_packed(np.fromiter((i for x in ids for i in x), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("group"), pa.array(many, pa.binary()), pa.array(out, pa.binary())], ["block", "group", "many", "ids"])

    return run


def _reassembled(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            words = batch.column("words")[row].values
            parts = sorted(batch.column("w")[row].as_py() or [], key=lambda x: x["group"])
            flat = np.concatenate([np.zeros(0, np.int32), *(_unpacked(x["ids"]) for x in parts)])
            length = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x["many"]) for x in parts)])
            # By word number: where its ids begin and how many there are.
            order = np.argsort(_places(words), kind="stable")
            first, many = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            first[order], many[order] = np.cumsum(length) - length, length
            numbers, counts = _unpacked(batch.column("numbers")[row].as_py()), batch.column("counts")[row].values.to_pylist()
            doc_ids, done, group, size = batch.column("doc_ids")[row].values, 0, [], 0
            for k, n in enumerate(counts):
                mine = numbers[done : done + n]
                done += n
                here = many[mine]
                ends = np.cumsum(here)
                group.append(flat[np.repeat(first[mine] - (ends - here), here) + np.arange(ends[-1])] if n else flat[:0])
                size += len(group[-1])
                if size > 1 << 20 or k + 1 == len(counts):
                    bounds = np.cumsum([0, *map(len, group)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(group), pa.int32()))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(k + 1 - len(group), len(group)), ids], ["doc_id", "token_ids"])
                    group, size = [], 0


def encode_words(docs: DataFrame, path: str | None = None, pattern: str | None = None, block_size: int = 8 << 20, group_words: int = 1 << 20) -> DataFrame:
    """doc_id, token_ids of every row of docs (doc_id, text; other columns are ignored).

    The texts are cut into words by the pattern; neighbouring documents form a block of some block_size characters, which
    keeps its distinct words once and, per position, the number of the word that stands there. The words of all blocks
    are shuffled together in groups by a hash, each distinct word is encoded once in its group, its ids go back to the blocks
    that have it, and every block puts its documents together by position. A word comes from a block once at most, so even
    the most frequent word moves no more often than there are blocks, and a task keeps one group's distinct words in memory, at
    most about group_words. Words of one block and group travel as one row. The blocks lie in buckets by
    their number, so they are written once and never shuffled: only words and ids move.

    A null text counts as empty and has no ids; repeated rows and null doc_ids come out each. A long text is
    cut into words in stretches between white space, and lies in one block whole, as it does in its row.
    """
    ranks, pattern = vocabulary(path, pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    layout = f"block long, n_words long, words array<string>, doc_ids array<{kind}>, counts array<long>, numbers binary"
    blocks = saved_in_buckets(rows.mapInArrow(_words(pattern, block_size), layout), "block", "blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // group_words))
    words = blocks.where("n_words > 0").select("block", "words").mapInArrow(_dealt(groups), "block long, group long, sizes binary, letters binary")
    back = words.repartition("group").sortWithinPartitions("group").mapInArrow(_encoded(ranks), "block long, group long, many binary, ids binary")
    back = back.groupBy("block").agg(F.collect_list(F.struct("group", "many", "ids")).alias("w"))
    whole = blocks.join(back.hint("merge"), "block", "left")
    return whole.select("words", "doc_ids", "counts", "numbers", "w").mapInArrow(_reassembled, f"doc_id {kind}, token_ids array<int>")


def decode_words(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of tokens (doc_id, token_ids, ...) and `decoded`, the bytes of the ids in their order.

    The table of tokens and their bytes has a row per id of the vocabulary, whatever the input, so it is sent to all
    tasks and each batch of ids is joined with it by id. Null ids give null, no ids no bytes.
    An id that the vocabulary lacks, and a null one, adds nothing.
    """
    ranks, _ = vocabulary(path)
    table = [b""] * (max(ranks.values()) + 2)
    for token, i in ranks.items():
        table[i] = token
    names = tokens.columns

    def run(batches):
        limit = len(table) - 1
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            ids = batch.column("token_ids")
            out = []
            for row in range(len(ids)):
                mine = ids[row].values
                if mine is None:
                    out.append(None)
                    continue
                at = mine.fill_null(limit).to_numpy()
                out.append(b"".join(map(table.__getitem__, np.where((at >= 0) & (at < limit), at, limit).tolist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{layout}, decoded binary")
