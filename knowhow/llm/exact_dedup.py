"""Exact deduplication: frequent digests are settled by a broadcast, all others by one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowhow.llm.common import ascii_lower, saved, take_rows


def digest(text):
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def frequent_digests(rows: DataFrame, shards: int = 32, counters: int = 1024, kept: int = 128) -> DataFrame:
    """(text_sha256, _best, group_size) of digests that a Misra-Gries summary found frequent, counted exactly.

    approx_top_k is Spark's Misra-Gries summary: a fixed set of counters, all lowered when they run out. Each shard of
    the digest space has a summary of its own, so that summaries merge in `shards` tasks and not in one. A digest with
    more than a few thousandths of its shard's rows is always found. At most shards * kept rows result, whatever the
    input, and each is verified: winner and size come from a count of the rows themselves.
    """
    key = F.xxhash64("text_sha256")
    found = (
        rows.groupBy(F.pmod(key, F.lit(shards)).alias("shard"))
        .agg(F.expr(f"approx_top_k(xxhash64(text_sha256), {kept}, {counters})").alias("top"))
        .select(F.explode("top").alias("top"))
        .where("top.count > 1")
        .select(F.col("top.item").alias("_key"))
    )
    return (
        rows.withColumn("_key", key)
        .join(F.broadcast(found), "_key", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text; other columns are ignored).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest doc_id
    stays, of repeated rows with that doc_id one; a null doc_id is smaller than all others. An empty table gives an
    empty result.
    """
    rows = saved(
        docs.select("doc_id", digest(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")),
        "digests",
    )
    winners = saved(frequent_digests(rows), "frequent")
    # Bounded by shards * kept rows of the summary.
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    same = Window.partitionBy("text_sha256")
    cold = rest.withColumns({
        "_best": F.max(F.struct("doc_id", "_row")).over(same), "group_size": F.count(F.lit(1)).over(same),
    })
    return hot.unionByName(cold).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("_best._row") == F.col("_row")).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns. Where doc_id and text repeat, one of the repeated rows stays."""
    keep = exact_groups(docs).where("kept").select(
        F.concat_ws("|", F.col("doc_id").cast("string"), "text_sha256").alias("_keep")).distinct()
    key = F.concat_ws("|", docs["doc_id"].cast("string"), digest(docs["text"]))
    return take_rows(docs, key, keep)
