"""Checks of generated statements against the material they claim to rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowhow import constants as K
from knowhow.functions import text as T

# Sections of a brief (fixed values, in our codes).
STRENGTH, RECORD, AMBITION, CAVEAT, RELATION = "strength", "track_record", "ambition", "caveat", "relation"
NO_MATCH = "The material has no experience that matches the query directly (closest note as source)."
NOT_DIRECT = "not direct: "
# How a model likes to begin (fixed value): adds nothing under a person's name.
OPENER = "^この人(は|が)[、,]?"
PARTIAL_MARK = " (source says so only in part)"


def verify_claims(claims: DataFrame, material: DataFrame, has_query: bool = True, max_items: int = K.BRIEF_MAX_ITEMS,
                  max_text: int = K.BRIEF_MAX_TEXT, mark: str = "。", full_texts: DataFrame | None = None) -> DataFrame:
    """Judge every claim; kept ones carry their usable sources, their text as shown and their position.

    claims: (claim_id, emp_id, section, seq, text, level, sources array<string>)
    material: (emp_id, source, doc_id, doc_type, status, text)
    full_texts: (doc_id, text), any number of rows per document; their numbers count for everybody who has the document
    reason is null for kept claims; ``position`` is null for dropped claims and for those beyond ``max_items``.
    ``sources`` are the named ones that may be used, ``bad_sources`` the others; the latter are told for claims that
    got as far as the check of their sources.
    """
    c = claims.withColumn("text", F.trim("text"))
    no_relation = (F.col("section") == RELATION) & F.coalesce(F.col("level") == "none", F.lit(False))
    c = c.where((F.length("text") > 0) | no_relation).withColumn("no_relation", no_relation)
    if not has_query:
        c = c.where(F.col("section") != RELATION)

    known = material.groupBy("emp_id", "source").agg(
        F.max("doc_id").alias("doc_id"), F.max("doc_type").alias("doc_type"), F.max("status").alias("status")
    )
    s = c.select("claim_id", "emp_id", "section", F.posexplode(F.array_distinct("sources")).alias("i", "source"))
    s = s.join(known, ["emp_id", "source"])
    usable = (F.col("section") != RECORD) | (
        (F.col("doc_type") == "project") & F.coalesce(F.col("status").isin("done", "running"), F.lit(False))
    )
    # A claim names a handful of sources, so the list per claim is short.
    good = s.where(usable).groupBy("claim_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "source"))), lambda x: x["source"]).alias("good"),
        F.count(F.col("doc_id")).alias("n_docs"),
    )
    stated = c.select("claim_id", "emp_id", F.explode(T.numbers("text")).alias("number"))
    given = material.select("emp_id", F.explode(T.numbers("text")).alias("number")).distinct()
    if full_texts is not None:
        # Only numbers that some claim states, and only documents of people with claims, are joined.
        have = material.where(F.col("doc_id").isNotNull()).join(c.select("emp_id").distinct(), "emp_id", "left_semi").select("emp_id", "doc_id").distinct()
        held = full_texts.select("doc_id", F.explode(T.numbers("text")).alias("number")).join(stated.select("number").distinct(), "number", "left_semi")
        given = given.unionByName(have.join(held.distinct(), "doc_id").select("emp_id", "number")).distinct()
    extra = stated.join(given, ["emp_id", "number"], "left_anti").select("claim_id").distinct().withColumn("extra", F.lit(True))

    c = c.join(good, "claim_id", "left").join(extra, "claim_id", "left")
    none = F.size(F.coalesce("good", F.array().cast("array<string>"))) == 0
    reason = (
        F.when((F.col("section") == STRENGTH) & (F.coalesce("n_docs", F.lit(0)) == 0), "no document source")
        .when(F.col("extra"), "number not in material")
        .when(none & (F.col("section") != CAVEAT) & ~F.col("no_relation"), "no source")
    )
    told = F.regexp_replace("text", OPENER, "")
    shown = F.when(F.col("no_relation"), F.lit(NO_MATCH)).when(
        (F.col("section") == RELATION) & ~F.coalesce(F.col("level") == "direct", F.lit(False)),
        F.concat(F.lit(NOT_DIRECT), told),
    ).otherwise(told)
    nothing = F.array().cast("array<string>")
    usable_ones = F.coalesce("good", nothing)
    bad = F.filter(F.coalesce("sources", nothing), lambda x: x.isNotNull() & ~F.array_contains(usable_ones, x))
    c = c.withColumn("reason", reason)
    c = c.withColumn("bad_sources", F.when(F.col("reason").isNull() | (F.col("reason") == "no source"), bad).otherwise(nothing))
    c = c.withColumn("shown", T.clip(shown, max_text, mark))
    w = Window.partitionBy("emp_id", "section").orderBy("seq", "claim_id")
    kept = c.where(F.col("reason").isNull()).withColumn("position", F.row_number().over(w)).where(F.col("position") <= max_items)
    c = c.join(kept.select("claim_id", "position"), "claim_id", "left")
    return c.select(
        "claim_id", "emp_id", "section", "seq", "level", "reason", "position", "shown",
        usable_ones.alias("sources"), "bad_sources",
    )


def apply_verdicts(kept: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drop claims judged unsupported, mark those supported in part. ``verdicts``: (claim_id, verdict)."""
    v = kept.join(verdicts.select("claim_id", "verdict"), "claim_id", "left")
    v = v.where(F.coalesce("verdict", F.lit("supported")) != "unsupported")
    return v.withColumn(
        "shown", F.when(F.col("verdict") == "partial", F.concat("shown", F.lit(PARTIAL_MARK))).otherwise(F.col("shown"))
    )


def drop_unknown_codes(messages: DataFrame, allowed: DataFrame) -> DataFrame:
    """(message_id, kept_text, n_dropped, dropped): sentences citing a document code the message may not use are removed."""
    s = messages.select("message_id", F.posexplode(T.sentences(F.trim("text"))).alias("i", "sentence"))
    cited = s.select("message_id", "i", F.explode(T.doc_codes("sentence")).alias("code"))
    bad = cited.join(allowed.select("message_id", "code"), ["message_id", "code"], "left_anti").select(
        "message_id", "i"
    ).distinct().withColumn("bad", F.lit(True))
    s = s.join(bad, ["message_id", "i"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))

    def joined(cond, sep):
        rows = F.sort_array(F.collect_list(F.when(cond, F.struct("i", "sentence"))))
        return F.array_join(F.transform(rows, lambda x: x["sentence"]), sep)

    # The pieces of one message add up to that message again.
    out = s.groupBy("message_id").agg(
        F.trim(joined(~F.col("bad"), "")).alias("kept_text"), F.count(F.when(F.col("bad"), 1)).alias("n_dropped"),
        joined(F.col("bad"), "").alias("dropped"),
    )
    return out


def usable_experience(claims: DataFrame) -> DataFrame:
    """Claims a message may rest on: text and sources present, and not a declared non-match."""
    return claims.where(
        F.col("section").isin(STRENGTH, RECORD, AMBITION, RELATION) & (F.length("shown") > 0) & (F.size("sources") > 0)
        & ~((F.col("section") == RELATION) & F.coalesce(F.col("level") == "none", F.lit(False)))
    )
