"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowhow.llm.common import positions, row_key, saved, take_rows, word_count


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: words that each source gives to the mix.

    Sources in code-point order, null last, take the weights in turn. A target stops at cap times its source's size;
    the excess is shared again among the others by weight until none is above. Only totals reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(totals.withColumn("_all", F.lit(0)), ["_all"], ["source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = saved(ranked.select("source", "source_size", weight.alias("weight"), (cap * F.col("source_size")).alias("most")), "sources")
    budget = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("most")
        n, taken, free = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not free:
            break
        level, full = (budget - (taken or 0.0)) / free, n
    return ranked.select("source", "source_size", F.when(F.col("weight") * level > F.col("most"), F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def mix_counts(docs: DataFrame, seed: str = "mix", carry: dict | None = None, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of docs (doc_id, text, source).

    Within a source, rows ordered by size and doc_id add up their expected copies (target / source size each). With
    one random offset for the source, a row is emitted once for each integer its sum crosses. Ordering by size keeps
    the words taken within about one document of the target. Null texts have no words; sources without words take
    nothing; null is a source of its own. `carry` names further columns to hand on.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[v.alias(k) for k, v in (carry or {}).items()])
    sizes = saved(sizes, "sizes")
    targets = source_targets(sizes, **how)
    placed = positions(sizes, ["source"], ["size", "doc_id", *(carry or {})], "_pos")
    name = F.coalesce(F.concat(F.lit(f"{seed}:"), F.col("source")), F.lit(f"{seed}?"))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target", rate.alias("_rate"), offset.alias("_offset"))
    mixed = placed.join(targets, placed["source"].eqNullSafe(targets["_source"]))
    crossed = F.floor((F.col("_pos") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(F.col("_pos") * F.col("_rate") + F.col("_offset"))
    return mixed.withColumn("copies", crossed.cast("long")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *(carry or {}))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """Rows of docs with their columns, each as often as the mix takes it (repeated rows: as often as all of them together)."""
    counts = mix_counts(docs, carry={"_key": row_key(docs)}, **how).where("copies > 0")
    return take_rows(docs, row_key(docs), counts.groupBy("_key").agg(F.sum("copies").alias("__copies")), "__copies")
