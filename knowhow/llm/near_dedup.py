"""Near-duplicate documents by HyperMinHash registers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.llm.common import saved, take_rows, thinned
from knowhow.llm.linking import Banding, similar_classes
from knowhow.llm.shingles import minima, pack, set_names, shingle_sets

MANTISSA = 10
#: 128 registers of 16 bits in 32 bands of 4: two sets of similarity 0.8 share no band once in 2e7 pairs. The margin
#: is 4.5 standard deviations of the estimate. Two unequal minima fall into one register with probability
#: 0.72 / 2**10 * n * m / (n + m)**2: a register is 0.72 of its minimum's size wide on average, relative to 2**10.
HYPER = Banding(bands=32, rows=4, bits=16, margin=0.17, collide=0.72 / 2**MANTISSA)


def hyper_registers(least: np.ndarray) -> np.ndarray:
    """16 bits per bucket: the leading zeros of its least hash (6 bits) and the bits after the leading one (10)."""
    fraction, length = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - length, 0, 63).astype(np.uint64)
    mantissa = np.clip((fraction * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint64)
    return (zeros << np.uint64(MANTISSA)) | mantissa


def _bytes(column) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass").lower() for x in column.to_pylist()]


def _slices(batches, rows=512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _marks(k: int):
    def run(batches):
        for t in _slices(batches):
            h, bounds = shingle_sets(_bytes(t.column("text")), k)
            h1, h2 = set_names(h, bounds)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            sig = np.zeros((len(n), HYPER.bands), np.int64)
            if len(full):
                at = np.concatenate([bounds[full], [len(h)]])
                sig[full] = pack(hyper_registers(minima(h, at, HYPER.bands * HYPER.rows)), HYPER.rows, HYPER.bits)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * HYPER.bands), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("tie"), pa.array(n), pa.array(h1), pa.array(h2), flat], ["doc_id", "tie", "n", "h1", "h2", "sig"])

    return run


def _sets(k: int):
    def run(batches):
        for t in _slices(batches, 64):
            h, bounds = shingle_sets(_bytes(t.column("text")), k)
            h1, h2 = set_names(h, bounds)
            flat = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), flat], ["h1", "h2", "shingles"])

    return run


def _labelled(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, tie, n, first (doc_id, tie) of every row; tie tells rows with one doc_id and different texts apart."""
    tied = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    marks = saved(tied.mapInArrow(_marks(words), "doc_id long, tie long, n long, h1 long, h2 long, sig array<long>"), "marks")
    marks = marks.withColumn("place", F.struct("doc_id", "tie"))

    def whole_sets(asked):
        wanted = asked.select(F.col("place.doc_id").alias("_id")).distinct()
        some = thinned(docs.select("doc_id", "text"), "doc_id", wanted).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        return some.select("text").mapInArrow(_sets(words), "h1 long, h2 long, shingles array<long>")

    full = marks.where("n > 0")
    classes = similar_classes(full, whole_sets, HYPER).select("h1", "h2", "first")
    linked = full.join(classes, ["h1", "h2"]).select("doc_id", "tie", "n", "first")
    return linked.union(marks.where("n = 0").select("doc_id", "tie", "n", "place"))


def near_groups(docs: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text; other columns are ignored).

    A document's set holds its distinct shingles of `words` words (maximal runs without ASCII white space) after
    lower-casing A-Z; with fewer words the whole sequence is one; null or no words: empty, linked with nothing.
    Documents whose sets have a Jaccard similarity of 0.8 or more are linked (confirmed on the whole sets), and
    component_id is the least doc_id that links reach. Repeated rows and equal texts are in one component. Null
    doc_ids rank before all others.
    """
    component = F.col("first.doc_id")
    return _labelled(docs, words).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """Rows of docs, one document of each group (that of the least doc_id), with their columns; repeated rows stay once."""
    def key(doc_id, tie):
        return F.concat_ws("|", doc_id.cast("string"), tie.cast("string"))

    stays = _labelled(docs, words).where("doc_id <=> first.doc_id AND tie = first.tie")
    return take_rows(docs, key(docs["doc_id"], F.xxhash64(docs["text"])), stays.select(key(F.col("doc_id"), F.col("tie"))).distinct())
