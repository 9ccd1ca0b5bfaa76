"""Lookups for people and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowhow import constants as K
from knowhow.functions import derive as D, text as T
from knowhow.session import rank_within


def person_documents(people: DataFrame, authors: DataFrame, documents: DataFrame, hits: DataFrame) -> DataFrame:
    """A found person's documents, newest first, marked where the query hit them. ``people``: (query_id, emp_id)."""
    d = documents.select("doc_id", "doc_code", D.doc_label().alias("label"), D.doc_date().alias("doc_date"))
    h = hits.select("query_id", "doc_id", F.lit(True).alias("hit"))
    x = people.select("query_id", "emp_id").join(authors.select("emp_id", "doc_id", "role"), "emp_id").join(d, "doc_id")
    x = x.join(h, ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return rank_within(x, ["query_id", "emp_id"], F.desc("doc_date"), "doc_id")


def career_items(notes: DataFrame) -> DataFrame:
    """(emp_id, items): names of the self-written items a person filled in (a handful of kinds)."""
    return notes.where(F.col("memo_kind").isNotNull()).groupBy("emp_id").agg(
        F.array_join(F.sort_array(F.collect_set("memo_kind")), ",").alias("items")
    )


def role_catalog(authors: DataFrame, documents: DataFrame) -> DataFrame:
    """For each role the document type it occurs with most, and how often."""
    n = authors.join(documents.select("doc_id", "doc_type"), "doc_id").groupBy("role", "doc_type").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("doc_type", "n"), F.struct("n", "doc_type")).alias("b")
    return n.groupBy("role").agg(best).select("role", "b.doc_type", "b.n")


def document_detail(documents: DataFrame, authors: DataFrame, employees: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per author and per section of each document, under the document's head; sections carry their number."""
    a = authors.join(employees.select("emp_id", "name", "emp_no"), "emp_id").select(
        "doc_id", F.lit("author").alias("part"), F.lit(0).alias("item_no"), F.concat_ws(" ", "emp_no", "name").alias("item"),
        F.col("role").alias("item_role"),
    )
    s = sections.select(
        "doc_id", F.lit("section").alias("part"), F.col("section_no").alias("item_no"), F.col("section_name").alias("item"),
        F.col("section_role").alias("item_role"),
    )
    head = documents.select("doc_id", "doc_code", "title", D.doc_label().alias("label"), D.doc_date().alias("doc_date"))
    return head.join(a.unionByName(s), "doc_id", "left")


def person_material(notes: DataFrame, documents: DataFrame) -> DataFrame:
    """Notes with the label of their source, in (date, source) order within the person."""
    d = documents.select("doc_id", "doc_code", "doc_type", D.doc_state().alias("status"))
    m = notes.join(d, "doc_id", "left").withColumn(
        "source", F.when(F.col("doc_id").isNull(), F.concat(F.lit("career:"), "label")).otherwise(F.col("doc_code"))
    )
    return rank_within(m, ["emp_id"], "note_date", "source")


def full_texts(evidence: DataFrame, sections: DataFrame, top: int = K.BRIEF_DOCS, limit: int = K.BRIEF_DOC_CHARS,
               mark: str = "。") -> DataFrame:
    """Whole section text of a person's leading documents, cut to the limit. ``evidence``: (query_id, emp_id, doc_id, place).

    A document's sections are read up to the limit only: the cut never looks further than that.
    """
    docs = evidence.where(F.col("place") <= top).select("doc_id").distinct()
    piece = F.concat(F.lit("■"), "section_name", F.lit("\n"), "body")
    s = sections.join(docs, "doc_id", "left_semi").select("doc_id", "section_no", T.squash(piece).alias("t"))
    before = Window.partitionBy("doc_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("start", F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0))).where(F.col("start") <= limit + 1)
    text = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_no", "t"))).alias("l"))
    text = text.select("doc_id", T.clip(F.array_join(F.transform("l", lambda x: x["t"]), " "), limit, mark).alias("full_text"))
    return evidence.where(F.col("place") <= top).select("query_id", "emp_id", "doc_id", "place").join(text, "doc_id")
