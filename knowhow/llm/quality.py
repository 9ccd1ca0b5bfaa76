"""Quality of documents by a byte-level convolutional network."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 8, 24, 16
#: Bytes of a chunk, and by how many two neighbours overlap so that no window is lost at a border.
CHUNK, OVERLAP = 512, WIDTH - STRIDE
STEP = CHUNK - OVERLAP


def chunks_of(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text, the last padded with zero bytes; one chunk for an empty text."""
    n = max(1, -(-max(len(text) - OVERLAP, 0) // STEP))
    a = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    a[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(a, (n, CHUNK), (STEP, 1)).copy()


class ByteNetwork:
    """Byte embeddings, learned filters over windows of 8 bytes, maximum per chunk and filter, a hidden layer per
    chunk, maximum and mean over the chunks, one probability."""

    NAMES = ("embed", "filters", "offset", "hidden", "hidden_offset", "out", "bias")

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        f = np.float32
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(f)
        self.filters = r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f)
        self.offset = np.zeros(FILTERS, f)
        self.hidden = r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(f)
        self.hidden_offset = np.zeros(HIDDEN, f)
        self.out = r.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN).astype(f)
        self.bias = np.zeros(1, f)

    def _windows(self, chunks):
        starts = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
        return chunks[:, starts[:, None] + np.arange(WIDTH)]  # chunk, window, byte

    def _top(self, peak, bounds):
        h = np.maximum(peak @ self.hidden + self.hidden_offset, 0)
        most = np.maximum.reduceat(h, bounds[:-1])
        mean = np.add.reduceat(h, bounds[:-1]) / np.diff(bounds)[:, None]
        both = np.concatenate([most, mean], axis=1).astype(np.float32)
        return h, most, both, both @ self.out + self.bias[0]

    def gradients(self, chunks, bounds, label, weight):
        """Loss gradients for documents whose chunks lie between bounds."""
        w = self._windows(chunks)
        n, m = w.shape[:2]
        x = self.embed[w].reshape(n * m, -1)
        act = (x @ self.filters).reshape(n, m, FILTERS)
        where = act.argmax(axis=1)
        peak = np.maximum(np.take_along_axis(act, where[:, None, :], 1)[:, 0] + self.offset, 0)
        h, most, both, logit = self._top(peak, bounds)
        p = 1 / (1 + np.exp(-logit))
        d = ((p - label) * weight).astype(np.float32)
        g = {"bias": d.sum(keepdims=True), "out": d @ both}
        d_both = d[:, None] * self.out
        doc = np.repeat(np.arange(len(label)), np.diff(bounds))
        d_h = d_both[doc, HIDDEN:] / np.diff(bounds)[doc][:, None]
        first = (h == most[doc]) & (h > 0)
        ties = np.add.reduceat(first, bounds[:-1], dtype=np.float32)[doc]
        d_h = (d_h + d_both[doc, :HIDDEN] * first / np.maximum(ties, 1)) * (h > 0)
        g["hidden"], g["hidden_offset"] = peak.T @ d_h, d_h.sum(axis=0)
        d_peak = (d_h @ self.hidden.T) * (peak > 0)
        g["offset"] = d_peak.sum(axis=0)
        x = x.reshape(n, m, -1)
        g["filters"] = np.zeros_like(self.filters)
        g["embed"] = np.zeros_like(self.embed)
        rows = np.arange(n)
        for f in range(FILTERS):
            at = where[:, f]
            g["filters"][:, f] = d_peak[:, f] @ x[rows, at]
            back = (d_peak[:, f, None] * self.filters[:, f]).reshape(n, WIDTH, EMBED)
            np.add.at(g["embed"], w[rows, at], back)
        return g

    def tables(self) -> list[np.ndarray]:
        """What each pair of bytes adds to every filter, by place in the window: a window's activation is four look-ups."""
        f = self.filters.reshape(WIDTH, EMBED, FILTERS)
        one = [self.embed @ f[j] for j in range(WIDTH)]
        return [(one[j][None, :, :] + one[j + 1][:, None, :]).reshape(-1, FILTERS) for j in range(0, WIDTH, 2)]

    def score(self, text: bytes, tables: list[np.ndarray], block: int = 128) -> float:
        chunks = chunks_of(text)
        peaks = []
        for at in range(0, len(chunks), block):
            pairs = chunks[at : at + block].view("<u2")  # stride 2: windows start at even places
            m = (CHUNK - WIDTH) // STRIDE + 1
            act = tables[0][pairs[:, :m]]
            for j in range(1, WIDTH // 2):
                act += tables[j][pairs[:, j : j + m]]
            peaks.append(np.maximum(act.max(axis=1) + self.offset, 0))
        return float(self._top(np.concatenate(peaks), np.array([0, len(chunks)]))[3][0])


def fit(texts: list[bytes], labels: list[int], prior: float, rounds: int = 10, batch: int = 32, most_chunks: int = 48, rate: float = 4e-3, seed: int = 0) -> ByteNetwork:
    """A network trained with Adam on a balanced sample; `prior`, the share of label 1 among all, sets its last bias.

    In a round a document shows at most most_chunks neighbouring chunks, a new stretch each time.
    """
    net, r = ByteNetwork(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        net.out[:] = 0
        net.bias[:] = 0 if len(y) == 0 else (4 if y[0] else -4)
        return net
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    all_chunks = [chunks_of(t) for t in texts]
    first = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    second = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    step, total = 0, rounds * -(-len(y) // batch)
    for _ in range(rounds):
        order = r.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            parts = []
            for i in pick:
                c = all_chunks[i]
                s = int(r.integers(max(1, len(c) - most_chunks + 1)))
                parts.append(c[s : s + most_chunks])
            bounds = np.concatenate([[0], np.cumsum([len(c) for c in parts])])
            g = net.gradients(np.concatenate(parts), bounds, y[pick], weight[pick] / len(pick))
            step += 1
            now = rate * (1 - step / (total + 1))
            for k in net.NAMES:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                setattr(net, k, (getattr(net, k) - now * change).astype(np.float32))
    prior = min(max(prior, 0.01), 0.99)
    net.bias += np.float32(np.log(prior / (1 - prior)))
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1000) -> ByteNetwork:
    """A network from labelled rows (doc_id, label) outside the held-out fifth, at most per_class of each class.

    Taken are those with the least hash of doc_id, so the sample is spread over the corpus and bounded whatever its
    size. Rows without a label of 0 or 1 or without doc_id teach nothing; a null text is an empty one.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = one if sample is None else sample.unionByName(one)
    # At most 2 * per_class rows of ids: a proven bound.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    texts, ys = [], []
    for r in sorted(rows.toLocalIterator(), key=lambda r: r["doc_id"]):
        texts.append((r["text"] or "").encode("utf-8", "surrogatepass"))
        ys.append(int(r["y"]))
    return fit(texts, ys, count.get(1, 0) / max(1, sum(count.values())))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _scores(net: ByteNetwork):
    def run(batches):
        tables = net.tables()
        for batch in batches:
            logits = [net.score((x or "").encode("utf-8", "surrogatepass"), tables) for x in batch.column("text").to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(logits, np.float64), -60, 60)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns)], pa.array(np.round(p, 6))], [*batch.schema.names, "__score"])

    return run


def with_scores(docs: DataFrame, net: ByteNetwork) -> DataFrame:
    """docs with one more column, __score."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scores(net), f"{kinds}, __score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text; other columns are ignored).

    Only the text's bytes enter a score. Chunks cover the whole text; a null text counts as an empty one, which has a
    score too. Repeated rows get equal scores. Without labels the score is 0.5 everywhere. A null doc_id is not held out.
    """
    net = train(docs, labels, **how)
    out = with_scores(docs.select("doc_id", "text"), net)
    score = F.col("__score")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"),
                      F.when(score >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """Rows of docs that are not rejected, with their columns."""
    net = train(docs, labels, **how)
    return with_scores(docs, net).where(F.col("__score") >= threshold).drop("__score")
