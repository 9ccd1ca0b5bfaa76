"""Person profiles: notes from documents and self-written sheets, assembled into one text per person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowhow import constants as K
from knowhow.functions import derive as D, text as T


def common_keywords(keywords: DataFrame, n_docs: DataFrame, max_df: float = K.TAG_MAX_DF) -> DataFrame:
    df = keywords.groupBy("keyword").agg(F.count_distinct("doc_id").alias("df")).withColumn("_one", F.lit(1))
    total = n_docs.withColumn("_one", F.lit(1))
    return df.join(total, "_one").where(F.col("df") / F.col("n_docs") > max_df).select("keyword")


def document_tags(keywords: DataFrame, common: DataFrame, n: int = K.TAG_N) -> DataFrame:
    """(doc_id, keyword, position): the most frequent keywords that are not common to many documents."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("count"), "keyword")
    kept = keywords.join(common, "keyword", "left_anti")
    return kept.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def note_bodies(documents: DataFrame, sections: DataFrame, limit: int = K.NOTE_CHARS, mark: str = "。") -> DataFrame:
    """(doc_id, body): first section of each wanted role, an equal share of the limit each, in role order."""
    roles = F.lit(-1)
    for t, names in K.NOTE_ROLES.items():
        for i, name in enumerate(names):
            roles = F.when((F.col("doc_type") == t) & (F.col("section_role") == name), i).otherwise(roles)
    s = sections.select("doc_id", "section_no", "section_role", "body").join(documents.select("doc_id", "doc_type"), "doc_id")
    s = s.withColumn("place", roles).where("place >= 0")
    first = s.groupBy("doc_id", "place").agg(F.min_by("body", "section_no").alias("body"))
    # At most three roles per document, so the list below is short.
    picked = first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("p"))

    def clipped(share):
        return F.array_join(F.transform("p", lambda x: T.clip(x["body"], limit // share, mark)), " ")

    n = F.size("p")
    return picked.select("doc_id", F.when(n == 1, clipped(1)).when(n == 2, clipped(2)).otherwise(clipped(3)).alias("body"))


def document_notes(documents: DataFrame, bodies: DataFrame, authors: DataFrame, tags: DataFrame,
                   skip_results=(), skip_statuses=()) -> DataFrame:
    """One note per (document, author); documents without body and skipped states are left out."""
    d = documents.where(~D.is_skipped(skip_results, skip_statuses)).join(bodies.where("body <> ''"), "doc_id")
    t = tags.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "keyword"))).alias("t"))
    d = d.join(t, "doc_id", "left").select(
        "doc_id", D.note_kind().alias("kind"), D.doc_label().alias("label"), D.doc_date().alias("note_date"), "title", "body",
        F.coalesce(F.array_join(F.transform("t", lambda x: x["keyword"]), " "), F.lit("")).alias("tags"),
    )
    return d.join(authors.select("doc_id", "emp_id", "role"), "doc_id").select(
        "emp_id", "doc_id", "kind", "label", "note_date", "role", "title", "body", "tags"
    )


def own_notes(memos: DataFrame, limit: int = K.MEMO_CHARS, mark: str = "。") -> DataFrame:
    """Self-written items (emp_id, memo_kind, body, updated_at, optionally created_at) in the shape of notes.

    An item that was never changed has the day it was made.
    """
    null = F.lit(None).cast("string")
    dates = [F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in ("updated_at", "created_at") if c in memos.columns]
    return memos.select(
        "emp_id", F.lit(None).cast("long").alias("doc_id"), F.lit("career").alias("kind"),
        F.coalesce("memo_kind", F.lit("self")).alias("label"), F.substring(F.coalesce(*dates), 1, 10).alias("note_date"),
        null.alias("role"), null.alias("title"), T.clip("body", limit, mark).alias("body"), F.lit("").alias("tags"),
    )


def use_summaries(notes: DataFrame, summaries: DataFrame) -> DataFrame:
    """A stored summary for (emp_id, doc_id) takes the place of the excerpt."""
    s = summaries.select("emp_id", "doc_id", F.col("body").alias("summary"))
    n = notes.join(s, ["emp_id", "doc_id"], "left")
    used = F.col("summary").isNotNull() & (F.col("summary") != "")
    return n.withColumn("body", F.when(used, F.col("summary")).otherwise(F.col("body"))).withColumn(
        "is_summary", used
    ).select(*notes.columns, "is_summary")


def formatted() -> Column:
    head = F.when(
        F.col("kind") == "career", F.concat(F.lit("[career|"), "label", F.lit("|"), "note_date", F.lit("]"))
    ).otherwise(
        F.concat(F.lit("["), "kind", F.lit("|"), "label", F.lit("|"), "role", F.lit("|"), "note_date", F.lit("]"))
    )
    lines = F.concat(head, F.coalesce("title", F.lit("")), F.lit("\n"), "body")
    return F.when(F.col("tags") != "", F.concat(lines, F.lit("\ntags: "), "tags")).otherwise(lines)


def assemble(notes: DataFrame, limit: int = K.PROFILE_CHARS) -> DataFrame:
    """(emp_id, profile_text, used, notes): notes in date order, the oldest dropped until the text fits.

    A person's notes are first summed per date, so only the dates near the limit are looked at note by note and
    at most ``limit`` characters per person are ever gathered, however many notes the person has.
    """
    n = notes.withColumn("text", formatted()).withColumn("len", F.length("text") + 2)
    n = n.withColumn("ord", F.coalesce("doc_id", F.lit(0))).withColumn("sub", F.coalesce("label", F.lit("")))
    total = n.groupBy("emp_id").agg(F.count(F.lit(1)).alias("notes"))
    days = n.groupBy("emp_id", "note_date").agg(F.sum("len").alias("len"))
    newer = Window.partitionBy("emp_id").orderBy(F.desc("note_date")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("before", F.coalesce(F.sum("len").over(newer), F.lit(0))).where(F.col("before") <= limit + 2)
    near = n.join(days.select("emp_id", "note_date", "before"), ["emp_id", "note_date"])
    newest = Window.partitionBy("emp_id", "note_date").orderBy(F.desc("ord"), F.desc("sub"), F.desc("text"))
    inside = newest.rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("through", F.col("before") + F.sum("len").over(inside)).where(F.col("through") <= limit + 2)
    text = near.groupBy("emp_id").agg(
        F.sort_array(F.collect_list(F.struct("note_date", "ord", "sub", "text"))).alias("l"), F.count(F.lit(1)).alias("used")
    )
    return total.join(text, "emp_id", "left").select(
        "emp_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["text"]), "\n\n"), F.lit("")).alias("profile_text"),
        F.coalesce("used", F.lit(0)).alias("used"), "notes",
    )


def to_rebuild(built: DataFrame, stored: DataFrame) -> DataFrame:
    """Profiles that are new, whose text differs, or that never got a vector."""
    s = stored.select("emp_id", F.col("profile_text").alias("old_text"), "embedded_at", F.lit(True).alias("stored"))
    return built.join(s, "emp_id", "left").where(
        F.col("stored").isNull() | ~F.col("old_text").eqNullSafe(F.col("profile_text")) | F.col("embedded_at").isNull()
    ).select(*built.columns, F.col("stored").isNull().alias("is_new"))


def notes_to_write(notes: DataFrame, stored_notes: DataFrame, emp_ids: DataFrame | None = None) -> DataFrame:
    """Excerpt rows to upsert: summarised notes stay, self-written ones are never written; optionally some people only."""
    n = notes.where(F.col("doc_id").isNotNull())
    if emp_ids is not None:
        n = n.join(emp_ids.select("emp_id"), "emp_id", "left_semi")
    kept = stored_notes.where("body_source = 'summary'").select("emp_id", "doc_id")
    return n.join(kept, ["emp_id", "doc_id"], "left_anti").select("emp_id", "doc_id", "body", F.lit("excerpt").alias("body_source"))


def build_statistics(built: DataFrame) -> DataFrame:
    return built.select("*", F.length("profile_text").alias("len")).agg(
        F.count(F.lit(1)).alias("people"), F.sum("notes").alias("notes"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY len DESC)").cast("long").alias("median_len"),
        F.max("len").cast("long").alias("max_len"), F.count(F.when(F.col("used") < F.col("notes"), 1)).alias("cut_people"),
    )
