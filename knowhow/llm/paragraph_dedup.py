"""Repeated passages: paragraphs that are near copies of an earlier paragraph of the corpus."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.llm.common import saved, thinned
from knowhow.llm.linking import Banding, similar_classes
from knowhow.llm.shingles import minima, pack, set_names, word_sets, words_of

ROWS, BITS = 3, 21


def tuned(similarity: float = 0.8, miss: float = 1e-5) -> Banding:
    """Bands of three registers, as few as miss a pair of just that similarity with at most this probability.

    The estimate may fall short of the similarity by 4.5 standard deviations.
    """
    bands = math.ceil(math.log(miss) / math.log(1 - similarity**ROWS))
    deviation = math.sqrt(similarity * (1 - similarity) / (bands * ROWS))
    return Banding(bands=bands, rows=ROWS, bits=BITS, margin=4.5 * deviation, percent=round(100 * similarity))


def _paragraphs(texts, least: int, words: int):
    """((row, number, start, end), words, hashes, bounds) of the paragraphs of at least so many words, in columns; start
    and end in characters, hashes and bounds as of shingle_sets()."""
    place, bodies = [], []
    for row, text in enumerate(texts):
        for number, m in enumerate(re.finditer(r"[^\n]+", text or "")):
            if m.end() - m.start() >= 2 * least - 1:  # words and what parts them
                place.append((row, number, m.start(), m.end()))
                bodies.append(m[0].encode("utf-8", "surrogatepass").lower())
    word, owner = words_of(bodies)
    size = np.bincount(owner, minlength=len(bodies))
    enough = size >= least
    here = enough[owner]
    h, bounds = word_sets(word[here], (np.cumsum(enough) - 1)[owner[here]], int(enough.sum()), words)
    return np.array(place, np.int64).reshape(-1, 4)[enough].T, size[enough], h, bounds


def _marks(least: int, words: int, banding: Banding):
    buckets = banding.bands * banding.rows

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                t = batch.slice(at, 256)
                (row, number, start, end), size, h, bounds = _paragraphs(t.column("text").to_pylist(), least, words)
                if not len(row):
                    continue
                h1, h2 = set_names(h, bounds)
                sig = pack(minima(h, bounds, buckets) >> np.uint64(64 - BITS), ROWS, BITS)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * banding.bands), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [t.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(end),
                     pa.array(size, pa.int64()), pa.array(np.diff(bounds)), pa.array(h1), pa.array(h2), flat],
                    ["doc_id", "paragraph", "start", "end", "words", "n", "h1", "h2", "sig"])

    return run


def _sets(least: int, words: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                *_, h, bounds = _paragraphs(batch.slice(at, 64).column("text").to_pylist(), least, words)
                if len(h):
                    h1, h2 = set_names(h, bounds)
                    flat = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), flat], ["h1", "h2", "shingles"])

    return run


def repeated_paragraphs(docs: DataFrame, least_words: int = 25, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per occurrence of a repeated paragraph: doc_id, paragraph, start, end, words, keep_doc_id,
    keep_paragraph, occurrences, removed.

    A paragraph is a line without its newline; lines under least_words words (never fewer than one shingle) are left
    alone. Two paragraphs are linked when the Jaccard similarity of their sets of distinct `words`-word shingles,
    lower-cased A-Z, is at least `similarity`, confirmed on the whole sets. Of each component the first occurrence
    (least doc_id, then position) stays, all others are marked removed. start and end count characters of the text.
    Null and empty texts have no paragraphs; null doc_ids rank first. Repeated rows are occurrences like others; of
    equal places one stays in each row, so a row that repeats another as a whole is left to document deduplication.
    """
    banding = tuned(similarity)
    least = max(least_words, words)
    marks = saved(docs.select("doc_id", "text").mapInArrow(
        _marks(least, words, banding),
        "doc_id long, paragraph int, start long, end long, words long, n long, h1 long, h2 long, sig array<long>"), "paragraphs")

    def whole_sets(asked):
        wanted = asked.select(F.col("place.doc_id").alias("_id")).distinct()
        some = thinned(docs.select("doc_id", "text"), "doc_id", wanted).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        return some.select("text").mapInArrow(_sets(least, words), "h1 long, h2 long, shingles array<long>")

    classes = similar_classes(marks.withColumn("place", F.struct("doc_id", "paragraph")), whole_sets, banding)
    repeats = classes.where("rows > 1").select("h1", "h2", "first", F.col("rows").alias("occurrences"))
    found = marks.drop("sig", "n").join(repeats, ["h1", "h2"])
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("paragraph") == F.col("first.paragraph"))
    return found.select("doc_id", "paragraph", "start", "end", "words", F.col("first.doc_id").alias("keep_doc_id"),
                        F.col("first.paragraph").alias("keep_paragraph"), "occurrences", (~first).alias("removed"))
