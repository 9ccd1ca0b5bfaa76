"""Text search over (section, term, n) counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowhow.constants import BM25_B, BM25_K1, LIST_SIZE
from knowhow.functions import text as T

SALT = 8
SMALL = 500_000  # rows of (query, term) that may be sent to every task


def match_terms(query_terms: DataFrame, term_counts: DataFrame, item: str, small: int = SMALL, salt: int = SALT) -> DataFrame:
    """Occurrences of query terms in items.

    The query terms are counted: a short list is sent to all tasks and the long side stays in place. Otherwise both
    are joined by term. A frequent term has one row per item and would be a hot key, so the rows of a term are
    spread over ``salt`` sub-keys by item and the query terms repeated for each of them.
    """
    if query_terms.limit(small + 1).count() <= small:
        return term_counts.join(F.broadcast(query_terms), "term")
    short = query_terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    long = term_counts.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salt)).cast("int"))
    return long.join(short, ["term", "_salt"]).drop("_salt")


def query_terms(queries: DataFrame, tokens) -> DataFrame:
    """(query_id, term), each term once per query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens)).alias("term"))


def ranked(scores: DataFrame, n: int, item: str = "section_id", by: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(n, 0))


def search(queries_terms: DataFrame, term_counts: DataFrame, n: int = LIST_SIZE) -> DataFrame:
    """Any term matches; the score is the number of occurrences of the query's terms."""
    hits = match_terms(queries_terms, term_counts.select("section_id", "term", "n"), "section_id")
    return ranked(hits.groupBy("query_id", "section_id").agg(F.sum("n").cast("double").alias("score")), n)


def gram_counts(items: DataFrame, key: str, text, n: int = 2) -> DataFrame:
    return T.term_counts(items, [key], T.ngrams(text, n))


class _Grams:
    """Which grams the queries ask for, sent to all tasks, and how often a text has them."""

    def __init__(self, queries: list, n: int):
        self.ids, self.n = np.array([q.query_id for q in queries], np.int64), n
        mine = [np.unique(self._codes(q.text or "")) for q in queries]
        self.asked = np.unique(np.concatenate([np.zeros(0, self._kind()), *mine]))
        self.has = np.zeros((len(self.asked), len(queries)))
        for i, grams in enumerate(mine):
            self.has[np.searchsorted(self.asked, grams), i] = 1

    def _kind(self):
        return np.dtype((np.void, 4 * self.n))

    def _codes(self, text: str) -> np.ndarray:
        """The text's grams, each as one value."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint8).reshape(-1, 4)
        count = len(chars) - self.n + 1
        if count < 1:
            return np.zeros(0, self._kind())
        grams = np.lib.stride_tricks.sliding_window_view(chars, (self.n, 4))[:, 0].reshape(count, -1)
        return np.ascontiguousarray(grams).view(self._kind()).ravel()

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, asked gram) occurrences, and the number of grams of each text."""
        out, length = np.zeros((len(texts), len(self.asked))), np.zeros(len(texts))
        for row, text in enumerate(texts):
            grams, many = np.unique(self._codes(text or ""), return_counts=True)
            length[row] = many.sum()
            if len(grams) and len(self.asked):
                at = np.minimum(np.searchsorted(self.asked, grams), len(self.asked) - 1)
                hit = self.asked[at] == grams
                out[row, at[hit]] = many[hit]
        return out, length


def bm25(items: DataFrame, queries: DataFrame, key: str = "section_id", text: str = "body", n: int = 2,
         k1: float = BM25_K1, b: float = BM25_B, k: int | None = None, digits: int = 6, block: int = 2_000_000) -> DataFrame:
    """(query_id, key, score) over character n-grams; the query's grams count once each.

    All items with a gram in common, or with ``k`` the best k per query by the score rounded to ``digits`` (ties: smaller key).
    Two scans of the items: lengths and document counts first, then scores, formed where a text is read; with ``k`` each task
    keeps its best k, so no score of the others leaves it. The queries go to the tasks in blocks whose grams times
    queries stay below ``block``; every block is one such scan.
    """
    rows = queries.select("query_id", T.squeeze("text").alias("text")).orderBy("query_id")
    texts = items.select(F.col(key).alias("item"), T.squeeze(text).alias("text"))
    found = None
    for part in _blocks_of(rows, n, block):
        one = _bm25_block(texts, part, k1, b, k, digits)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = texts.sparkSession.createDataFrame([], f"query_id long, item {items.schema[key].dataType.simpleString()}, score double")
    found = found.withColumnRenamed("item", key)
    if k is None:
        return found
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks_of(rows: DataFrame, n: int, block: int):
    """Queries in blocks; they are read one by one, never all at once."""
    part, grams = [], 0
    for q in rows.toLocalIterator():
        size = max(len(q.text or "") - n + 1, 1)
        if part and (grams + size) * (len(part) + 1) > block:
            yield _Grams(part, n)
            part, grams = [], 0
        part.append(q)
        grams += size
    if part:
        yield _Grams(part, n)


def _bm25_block(texts: DataFrame, grams: _Grams, k1: float, b: float, k: int | None, digits: int) -> DataFrame:
    step = max(1, min(256, 4_000_000 // max(len(grams.asked), 1)))

    def slices(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield part.column("item"), *grams.counts(part.column("text").to_pylist())

    def statistics(batches):
        df, total, many = np.zeros(len(grams.asked), np.int64), 0, 0
        for _, counts, length in slices(batches):
            df += (counts > 0).sum(axis=0)
            total, many = total + int(length.sum()), many + len(length)
        place = np.concatenate([[-2, -1], np.flatnonzero(df)])
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate([[many, total], df[df > 0]]))], ["place", "n"])

    df, sizes = np.zeros(len(grams.asked)), {}
    for r in texts.mapInArrow(statistics, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # as many rows as asked grams
        if r.place < 0:
            sizes[r.place] = r.n
        else:
            df[r.place] = r.n
    items = sizes.get(-2, 0)
    mean = sizes.get(-1, 0) / items if items else 0.0
    idf = np.log(1 + (items - df + 0.5) / (df + 0.5))

    def scores(batches):
        best = None
        for item, counts, length in slices(batches):
            norm = k1 * (1 - b + b * length[:, None] / mean) if mean else np.ones((len(length), 1))
            score = (idf * counts * (k1 + 1) / (counts + norm)) @ grams.has
            row, q = np.nonzero((counts > 0).astype(np.float64) @ grams.has)
            new = q, item.take(pa.array(row)), score[row, q]
            if k is None:
                yield pa.RecordBatch.from_arrays([pa.array(grams.ids[q]), new[1], pa.array(new[2])], ["query_id", "item", "score"])
                continue
            if best is not None:
                new = np.concatenate([best[0], new[0]]), pa.concat_arrays([best[1], new[1]]), np.concatenate([best[2], new[2]])
            order = np.lexsort((pc.rank(new[1], tiebreaker="dense").to_numpy(), -np.round(new[2], digits), new[0]))
            first = new[0][order]
            order = order[np.arange(len(order)) - np.searchsorted(first, first) < k]
            best = new[0][order], new[1].take(pa.array(order)), new[2][order]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(grams.ids[best[0]]), best[1], pa.array(best[2])], ["query_id", "item", "score"])

    return texts.mapInArrow(scores, f"query_id long, item {texts.schema['item'].dataType.simpleString()}, score double")


def character_tfidf(items: DataFrame, key: str, text: str, max_features: int | None = None, sizes=(2, 3)) -> DataFrame:
    """(key, term, weight): character n-gram TF-IDF rows of unit length, a stand-in for embeddings.

    Sublinear term frequency, smoothed idf. All n-grams, or the most frequent ``max_features`` if the caller asks for so many.
    """
    grams = F.concat(*[T.ngrams(text, n) for n in sizes])
    tf = T.term_counts(items, [key], grams)
    stats = tf.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df"))
    features = stats if max_features is None else stats.orderBy(F.desc("total"), "term").limit(max_features)
    total = items.agg(F.count(F.lit(1)).alias("items")).withColumn("_one", F.lit(1))
    idf = features.withColumn("_one", F.lit(1)).join(total, "_one").select(
        "term", (F.log((1 + F.col("items")) / (1 + F.col("df"))) + 1).alias("idf")
    )
    w = tf.join(idf, "term").select(key, "term", ((1 + F.log("n")) * F.col("idf")).alias("w"))
    length = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return w.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("weight"))
