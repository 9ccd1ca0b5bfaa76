"""Registration of documents as they arrive: the merge and partial profile rebuild once per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knowhow.operators import profiles as P, rules as V
from knowhow.session import cut_lineage
from knowhow.sources import loading as L

TABLES = ("documents", "sections", "authors", "keywords")

ARRIVAL = """
    doc_id long, doc_code string, doc_type string, title string, result string, pj_status string, submitted_at date,
    started_at date, ended_at string, decided_at string,
    sections array<struct<section_no:int, section_name:string, section_role:string, body:string>>,
    authors array<struct<emp_id:long, role:string, dept_id_at_time:long>>
"""


#: Every so many versions the tables are written whole; between them a version holds what its batch changed.
WHOLE_EVERY = 20


def load_state(spark: SparkSession, folder: str, version: int) -> dict[str, DataFrame]:
    """The tables as of a version: the last whole ones, with the documents of each later batch in place of their older rows."""
    first = version - version % WHOLE_EVERY
    if first == version:
        return {t: spark.read.parquet(f"{folder}/v{version}/{t}") for t in TABLES}

    def rows(table: str) -> DataFrame:
        """Rows with the version they were written in."""
        one = [spark.read.parquet(f"{folder}/v{v}/{table}").withColumn("_v", F.lit(v)) for v in range(first, version + 1)]
        return reduce(DataFrame.unionByName, one)

    newest = rows("documents").groupBy("doc_id").agg(F.max("_v").alias("_v"))
    return {t: rows(t).join(newest, ["doc_id", "_v"], "left_semi").drop("_v") for t in TABLES}


def save_state(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    for t in TABLES:
        tables[t].write.mode("overwrite").parquet(f"{folder}/v{version}/{t}")


def refusals(arrivals: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """What is wrong with a batch, by arrival (its code, or its id where it has none)."""
    no_section = arrivals.select("arrival", F.explode("sections"))
    return V.union(
        V.cross_field(arrivals, "arrival"), V.code_pattern(arrivals, "arrival"), V.batch_codes(arrivals, stored["documents"], "arrival"),
        V.without_children(arrivals, "arrival", no_section),
    ).where("severity = 'problem'").select(F.col("row_key").alias("arrival"), "rule", "detail")


def register_batch(spark: SparkSession, arrivals: DataFrame, folder: str, version: int,
                   on_notes: Callable[[DataFrame], None] | None = None, model: Callable | None = None) -> None:
    """Apply one batch to version ``version`` of the tables and write version + 1, so that a repeated batch is harmless.

    A document is known by its code (see ``loading.registered_ids``). Arrivals that break a rule are written to
    ``refused`` with the rule, the others are merged: only their rows are written. ``model`` turns the texts of new sections into
    vectors; without it they wait with a null vector.
    """
    stored = load_state(spark, folder, version)
    arrivals = arrivals.withColumn("arrival", F.coalesce("doc_code", F.concat(F.lit("#"), F.col("doc_id").cast("string")), F.lit("?")))
    issues = cut_lineage(refusals(arrivals, stored))
    issues.join(arrivals.select("arrival", "doc_id", "doc_code", "title"), "arrival").write.mode("overwrite").parquet(f"{folder}/v{version + 1}/refused")
    good = L.registered_ids(arrivals.join(issues, "arrival", "left_anti"), stored["documents"])
    docs = good.select(*stored["documents"].columns)
    sections = good.select("doc_id", F.explode("sections").alias("s")).select(
        "doc_id", "s.*", F.xxhash64("doc_id", F.col("s.section_no")).alias("section_id")
    )
    authors = good.select("doc_id", F.explode("authors").alias("a")).select("doc_id", "a.*")
    merged = L.merge_registration(stored, docs, sections.drop("section_id"), authors, L.document_keywords(docs, sections))
    fresh = sections.select("doc_id", "section_no", F.col("section_id").alias("new_id"))

    def with_ids(df: DataFrame) -> DataFrame:
        named = df.join(fresh, ["doc_id", "section_no"], "left").withColumn("section_id", F.coalesce("section_id", "new_id")).drop("new_id")
        if model is not None:
            vectors = L.embed(L.to_embed(named, docs).select("section_id", "text"), model).select("section_id", F.col("embedding").alias("_vector"))
            named = named.join(vectors, "section_id", "left").withColumn("embedding", F.coalesce("embedding", "_vector"))
        return named.select(*stored["sections"].columns)

    whole = (version + 1) % WHOLE_EVERY == 0
    tables = {t: merged[t] if whole else merged["changed"][t] for t in TABLES}
    save_state(tables | {"sections": with_ids(tables["sections"])}, folder, version + 1)
    if on_notes is not None:
        tables = load_state(spark, folder, version + 1)
        tags = P.document_tags(tables["keywords"], P.common_keywords(
            tables["keywords"], tables["documents"].agg(F.count(F.lit(1)).alias("n_docs"))))
        people = merged["affected"]
        notes = P.document_notes(
            tables["documents"], P.note_bodies(tables["documents"], tables["sections"]),
            tables["authors"].join(people, "emp_id", "left_semi"), tags,
        )
        on_notes(P.assemble(notes))


def start(spark: SparkSession, source: str, state: str, checkpoint: str,
          on_notes: Callable[[DataFrame], None] | None = None, model: Callable | None = None) -> StreamingQuery:
    """Watch a folder of JSON arrivals; batch n turns version n of the tables into version n + 1."""
    arrivals = spark.readStream.schema(ARRIVAL).json(source)

    def apply(df: DataFrame, batch_id: int) -> None:
        register_batch(df.sparkSession, df, state, batch_id, on_notes, model)

    return (
        arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
