"""A stored text index: which sections hold which search terms, and how often.

Postings are rows (part, term, section_id, doc_id, n), in folders by a hash of the term, so that a look-up reads only the
folders of its terms, and in the order of (term, section_id) within a file. Every task writes its sections' postings to all folders: postings are not
shuffled, and a term in every section is not one task's work. Changed sections go to a delta that hides their older postings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.functions import text as T
from knowhow.operators import fulltext, network, similarity

PARTS = 64


def part_of(term, parts: int = PARTS):
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def postings(sections: DataFrame, text: str = "body", parts: int = PARTS) -> DataFrame:
    """Postings of sections (section_id, doc_id, text), in the order in which they are stored.

    Texts are dealt by section before their terms are counted, so that the many rows of terms stay where they form.
    """
    tasks = max(2 * sections.sparkSession.sparkContext.defaultParallelism, sections.rdd.getNumPartitions())
    tokens = F.transform(T.terms(text), lambda t: t["term"])
    dealt = sections.select("section_id", "doc_id", F.col(text).alias("text")).repartition(tasks, "section_id")
    counted = T.term_counts(dealt.select("section_id", "doc_id", F.col("text").alias(text)), ["section_id", "doc_id"], tokens)
    placed = counted.select(part_of("term", parts).alias("part"), "term", "section_id", "doc_id", "n")
    return placed.sortWithinPartitions("part", "term", "section_id")


def by_part(writer):
    return writer.partitionBy("part")


def term_statistics(index: DataFrame) -> DataFrame:
    """(term, df, total, most): sections and occurrences of each term, and the most in one section."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"), F.max("n").alias("most"))


def look_up(index: DataFrame, wanted: DataFrame, parts: int = PARTS) -> DataFrame:
    """Postings of the terms in ``wanted`` (term, any other columns), with those columns. Only the folders of those terms are read."""
    placed = wanted.withColumn("part", part_of("term", parts))
    folders = [r.part for r in placed.select("part").where("part is not null").distinct().collect()]  # at most `parts` numbers
    return index.where(F.col("part").isin(folders)).join(placed, ["part", "term"]).drop("part")


def search(index: DataFrame, query_terms: DataFrame, parts: int = PARTS) -> DataFrame:
    """(query_id, section_id, score): any term matches; the score is the number of occurrences of the query's terms."""
    hits = look_up(index, query_terms.select("query_id", "term"), parts)
    return hits.groupBy("query_id", "section_id").agg(F.sum("n").cast("double").alias("score"))


def best(index: DataFrame, query_terms: DataFrame, k: int, parts: int = PARTS) -> DataFrame:
    """(query_id, section_id, score, rank): the k best sections per query by ``search``, ties to the smaller id.

    A short list of queries goes to the tasks; the asked terms' postings come together by section, whose scores for all queries form in one task,
    which keeps the best k per query. So there is no row per posting and query that asks for it.
    """
    asked = query_terms.select(F.col("query_id").alias("emp_id"), "term", F.lit(1.0).alias("raw")).limit(fulltext.SMALL + 1).toArrow()
    ids = np.unique(asked.column("emp_id").to_numpy())
    if not 0 < asked.num_rows <= fulltext.SMALL or len(ids) > similarity.BLOCK_ROWS:
        return fulltext.ranked(search(index, query_terms, parts), k)
    terms = query_terms.sparkSession.createDataFrame([(t,) for t in asked.column("term").unique().to_pylist()], "term string")
    hits = look_up(index, F.broadcast(terms), parts).select("section_id", "term", "n")
    known = network.AskedTerms(asked, ids)

    def run(batches):
        found, size, least = [], 0, np.full(len(ids), 1.0)
        for section, place, term, n in _whole_sections(batches, known.terms):
            scores = known.dots(place, term, n, len(section)).T
            q, c = similarity._best(scores, scores >= least[:, None], k)
            found.append((q, section[c], scores[q, c]))
            size += len(q)
            if size > 4 * k * len(ids):
                found = [_first(found, k)]
                size = len(found[0][0])
                full = np.bincount(found[0][0], minlength=len(ids)) >= k
                least[full] = found[0][2][np.searchsorted(found[0][0], np.flatnonzero(full), "right") - 1]
        if found:
            q, section, score = _first(found, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(section), pa.array(score)], ["query_id", "section_id", "score"])

    dealt = hits.repartition("section_id").sortWithinPartitions("section_id")
    return fulltext.ranked(dealt.mapInArrow(run, "query_id long, section_id long, score double"), k)


def _first(found, k: int):
    """The k best (query, section, score) per query."""
    q, section, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((section, -score, q))
    q, section, score = q[order], section[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], section[keep], score[keep]


def _whole_sections(batches, terms: pa.Array, many: int = 256):
    """Sections, and their postings as (place of the section, place of the term, n); rows come in the order of sections."""
    rest = None
    for batch in network.gathered(batches):
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        ids = rows.column("section_id").to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))  # the last section may go on
        yield from _slices(rows.slice(0, cut), terms, many)
        rest = rows.slice(cut)
    if rest is not None:
        yield from _slices(rest, terms, many)


def _slices(rows: pa.Table, terms: pa.Array, many: int):
    sections, place = np.unique(rows.column("section_id").to_numpy(), return_inverse=True)
    term = pc.index_in(rows.column("term"), value_set=terms).to_numpy()
    n = rows.column("n").to_numpy().astype(np.float64)
    for first in range(0, len(sections), many):
        a, b = np.searchsorted(place, [first, first + many])
        yield sections[first : first + many], place[a:b] - first, term[a:b], n[a:b]


def with_changes(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None, text: str = "body", parts: int = PARTS) -> DataFrame:
    """The index after sections have changed (section_id, doc_id, text) or gone (section_id).

    Only changed texts are tokenised. The older postings of both are hidden; write the result to compact.
    """
    gone = changed.select("section_id")
    gone = gone.unionByName(removed.select("section_id")) if removed is not None else gone
    kept = index.join(gone.distinct(), "section_id", "left_anti")
    return kept.select("part", "term", "section_id", "doc_id", "n").unionByName(postings(changed, text, parts))
