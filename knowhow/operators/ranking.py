"""From section rankings to documents and people, for many queries in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowhow.constants import (
    BETA, FTS_MIN, LIST_SIZE, PLANNED_DISCOUNT, PROFILE_TOP, RRF_K, TODAY_YEAR, TOP_N, VEC_MIN, W_FTS,
)
from knowhow.functions import derive as D
from knowhow.functions.vector import mean_vectors, unit
from knowhow.operators import similarity
from knowhow.session import rank_within


def as_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(vec).alias("vec"))


def vector_search(queries: DataFrame, sections: DataFrame, k: int = LIST_SIZE) -> DataFrame:
    """(query_id, section_id, score, rank); the score is the cosine rounded to 4 digits."""
    hits = similarity.top_k(as_vectors(queries, "query_id", "qvec"), as_vectors(sections, "section_id", "embedding"), k)
    return hits.select(
        F.col("left_id").alias("query_id"), F.col("right_id").alias("section_id"),
        F.round("sim", 4).alias("score"), "rank",
    )


def rrf(rankings: Sequence[tuple[DataFrame, float]], k: int = RRF_K, item: str = "section_id") -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, item, rank) frames; weights <= 0 are ignored."""
    used = [
        r.select("query_id", item, (F.lit(float(w)) / (k + F.col("rank"))).alias("part"))
        for r, w in rankings if w > 0
    ]
    if not used:
        first = rankings[0][0]
        return first.select("query_id", item, F.lit(0.0).alias("score")).where(F.lit(False))
    both = used[0]
    for u in used[1:]:
        both = both.unionByName(u)
    return both.groupBy("query_id", item).agg(F.sum("part").alias("score"))


def gated_hybrid(vec: DataFrame, fts: DataFrame, w_fts: float = W_FTS, vec_min: float = VEC_MIN,
                 fts_min: float = FTS_MIN, k: int = RRF_K) -> DataFrame:
    """Fuse a cosine and a text ranking per query.

    Ranks are those before the cut-offs. A part counts only when its cut-off is passed; a query without any text
    hit uses the vector part alone. A section that passes a cut-off stays even if its part weighs nothing.
    """
    v = vec.select("query_id", "section_id", F.col("rank").alias("vec_rank"), F.col("score").alias("vec_cos"))
    f = fts.select("query_id", "section_id", F.col("rank").alias("fts_rank"), F.col("score").alias("fts_score"))
    has_text = f.select("query_id").distinct().withColumn("fts_used", F.lit(True))
    both = v.join(f, ["query_id", "section_id"], "full_outer").join(has_text, "query_id", "left")
    both = both.withColumn("fts_used", F.coalesce("fts_used", F.lit(False)))
    both = (
        both.withColumn("vec_ok", F.coalesce(F.col("vec_cos") >= vec_min, F.lit(False)))
        .withColumn("fts_ok", F.coalesce(F.col("fts_score") >= fts_min, F.lit(False)))
        .withColumn("wv", F.when(F.col("fts_used"), F.lit(1 - w_fts)).otherwise(F.lit(1.0)))
        .withColumn("wf", F.when(F.col("fts_used"), F.lit(float(w_fts))).otherwise(F.lit(0.0)))
    )
    vec_part = F.when(F.col("vec_ok"), F.col("wv") * (1.0 / (k + F.col("vec_rank")))).otherwise(F.lit(0.0))
    fts_part = F.when(F.col("fts_ok"), F.col("wf") * (1.0 / (k + F.col("fts_rank")))).otherwise(F.lit(0.0))
    return (
        both.where(F.col("vec_ok") | F.col("fts_ok"))
        .withColumn("vec_part", vec_part).withColumn("fts_part", fts_part)
        .withColumn("score", F.col("vec_part") + F.col("fts_part"))
    )


def doc_scores(section_scores: DataFrame, section_doc: DataFrame) -> DataFrame:
    """Best section per (query, document); ties go to the lower section id."""
    s = section_scores.join(section_doc.select("section_id", "doc_id").where(F.col("doc_id").isNotNull()), "section_id")
    best = F.max_by(F.struct("score", "section_id"), F.struct("score", -F.col("section_id")))
    return s.groupBy("query_id", "doc_id").agg(best.alias("b")).select("query_id", "doc_id", "b.score", "b.section_id")


def contributions(docs_scored: DataFrame, documents: DataFrame, authors: DataFrame, employees: DataFrame,
                  queries: DataFrame | None = None, weights: dict[str, float] | None = None, recency: float = 0.0,
                  years: Sequence[int] | None = None, depts: Sequence[int] | None = None,
                  planned_discount: float = 1.0, today_year: int = TODAY_YEAR) -> DataFrame:
    """(query_id, emp_id, doc_id, section_id, role, contribution, ...) for people who may be shown.

    ``queries`` may carry a ``searcher`` column; that person is left out of the query's results.
    """
    d = documents.select(
        "doc_id", F.year(D.ranking_date()).alias("year"), D.is_proven().alias("proven"), "doc_type", "pj_status"
    )
    x = docs_scored.join(d, "doc_id")
    if years:
        x = x.where(F.col("year").isin(*[int(y) for y in years]))
    factor: Column = F.lit(1.0)
    if recency:
        age = F.least(F.greatest(F.lit(today_year) - F.col("year"), F.lit(0)), F.lit(5))
        factor = F.when(F.col("year").isNotNull(), 1.0 - recency * age).otherwise(1.0)
    if planned_discount != 1.0:
        planned = F.coalesce(F.col("pj_status") == "planned", F.lit(False))
        factor = factor * F.when(planned, planned_discount).otherwise(1.0)
    e = employees.where("is_active").select("emp_id", "dept_id")
    if depts:
        e = e.where(F.col("dept_id").isin(*[int(v) for v in depts]))
    x = x.join(authors.select("doc_id", "emp_id", "role"), "doc_id").join(e, "emp_id")
    if queries is not None and "searcher" in queries.columns:
        x = x.join(queries.select("query_id", "searcher"), "query_id").where(
            F.col("searcher").isNull() | (F.col("searcher") != F.col("emp_id"))
        ).drop("searcher")
    return x.withColumn("role_weight", D.role_weight("role", weights)).withColumn(
        "contribution", F.col("score") * F.col("role_weight") * factor
    ).select("query_id", "emp_id", "dept_id", "doc_id", "section_id", "role", "role_weight", "contribution", "proven")


def numbered(contribs: DataFrame) -> DataFrame:
    """Contributions with their place in the person's list (place 1 = strongest)."""
    w = Window.partitionBy("query_id", "emp_id").orderBy(F.desc("contribution"), "doc_id")
    return contribs.withColumn("place", F.row_number().over(w))


def person_scores(contribs: DataFrame, beta: float = BETA) -> DataFrame:
    """Strongest document plus ``beta`` times the second; the frame follows the strongest document."""
    top2 = numbered(contribs).where("place <= 2")
    share = F.when(F.col("place") == 1, F.col("contribution")).otherwise(beta * F.col("contribution"))
    return top2.groupBy("query_id", "emp_id", "dept_id").agg(
        F.sum(share).alias("score"), F.max((F.col("place") == 1) & F.col("proven")).alias("proven"),
    )


def evidence(contribs: DataFrame, top: int = 3) -> DataFrame:
    return numbered(contribs).where(F.col("place") <= top).withColumn("contribution", F.round("contribution", 6))


def scale_similarity(sims: DataFrame) -> DataFrame:
    """Per query: 0 at the upper median, 1 at the maximum, clipped below."""
    # The upper median is the discrete 50% point of the descending order; sims are rounded, so the
    # aggregation state is bounded by the number of distinct rounded values.
    stats = sims.groupBy("query_id").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY sim DESC)").alias("floor"), F.max("sim").alias("ceil")
    )
    span = F.col("ceil") - F.col("floor")
    scaled = F.when(span > 0, F.greatest(F.col("sim") - F.col("floor"), F.lit(0.0)) / span).otherwise(0.0)
    return sims.join(stats, "query_id").select("query_id", "emp_id", "sim", scaled.alias("scaled"))


def blend_profiles(people: DataFrame, sims: DataFrame, employees: DataFrame, alpha: float, queries: DataFrame | None = None,
                   profile_top: int = PROFILE_TOP, years: Sequence[int] | None = None,
                   depts: Sequence[int] | None = None) -> DataFrame:
    """Mix the document path with profile similarity; the nearest profiles join as candidates.

    With alpha = 1 the people come back unchanged (path = score).
    """
    if alpha >= 1.0:
        return people.withColumn("path", F.col("score")).withColumn("profile", F.lit(0.0)).withColumn("on_path", F.lit(True))
    scaled = scale_similarity(sims)
    p = people.select("query_id", "emp_id", F.col("dept_id").alias("d1"), F.col("score").alias("raw"), "proven")
    if years:
        mixed = p.join(scaled, ["query_id", "emp_id"], "left")
    else:
        w = Window.partitionBy("query_id").orderBy(F.desc("scaled"), "emp_id")
        near = scaled.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= profile_top) & (F.col("scaled") > 0))
        e = employees.where("is_active")
        if depts:
            e = e.where(F.col("dept_id").isin(*[int(v) for v in depts]))
        near = near.join(e.select("emp_id"), "emp_id")
        if queries is not None and "searcher" in queries.columns:
            near = near.join(queries.select("query_id", "searcher"), "query_id").where(
                F.col("searcher").isNull() | (F.col("searcher") != F.col("emp_id"))
            )
        keys = p.select("query_id", "emp_id").unionByName(near.select("query_id", "emp_id")).distinct()
        mixed = keys.join(p, ["query_id", "emp_id"], "left").join(scaled, ["query_id", "emp_id"], "left")
    mixed = mixed.join(employees.select("emp_id", "dept_id"), "emp_id")
    top = p.groupBy("query_id").agg(F.max("raw").alias("top"))
    mixed = mixed.join(top, "query_id", "left")
    path = F.when(F.coalesce("top", F.lit(0.0)) > 0, F.coalesce("raw", F.lit(0.0)) / F.col("top")).otherwise(0.0)
    return mixed.withColumn("path", path).select(
        "query_id", "emp_id", "dept_id", "path", F.coalesce("scaled", F.lit(0.0)).alias("profile"),
        (alpha * F.col("path") + (1 - alpha) * F.coalesce("scaled", F.lit(0.0))).alias("score"),
        F.coalesce("proven", F.lit(False)).alias("proven"), F.col("raw").isNotNull().alias("on_path"),
    )


def frames(people: DataFrame, diversity: float = 0.0, top_n: int = TOP_N) -> DataFrame:
    """Top people per frame. Greedy re-picking with a per-department discount equals sorting by the score
    discounted by the person's place within the department, because the order inside a department never changes."""
    p = people.withColumn("frame", F.when(F.col("proven"), "proven").otherwise("hidden"))
    p = p.withColumn("effective", F.col("score"))
    if diversity:
        dept = Window.partitionBy("query_id", "frame", "dept_id").orderBy(F.desc("score"), "emp_id")
        p = p.withColumn("effective", F.col("score") * F.pow(F.lit(1 - diversity), F.row_number().over(dept) - 1))
    w = Window.partitionBy("query_id", "frame").orderBy(F.desc("effective"), F.desc("score"), "emp_id")
    return p.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_n)


def decompose(contribs: DataFrame, hybrid: DataFrame, beta: float = BETA) -> DataFrame:
    """Evidence rows (top 3) with the parts of their section score."""
    cols = ["query_id", "section_id", "vec_rank", "fts_rank", "vec_cos", "fts_score", "vec_ok", "fts_ok", "vec_part", "fts_part"]
    e = evidence(contribs).drop("role_weight").join(hybrid.select(*cols), ["query_id", "section_id"])
    total = F.col("vec_part") + F.col("fts_part")
    times = F.when(F.col("place") == 1, 1.0).when(F.col("place") == 2, beta).otherwise(0.0)
    return (
        e.withColumn("section_score", total)
        .withColumn("role_weight", F.when(total != 0, F.col("contribution") / total).otherwise(0.0))
        .withColumn("counted", F.col("place") <= 2)
        .withColumn("vec_share", F.when(total != 0, F.col("contribution") * F.col("vec_part") / total * times).otherwise(0.0))
        .withColumn("fts_share", F.when(total != 0, F.col("contribution") * F.col("fts_part") / total * times).otherwise(0.0))
    )


def person_parts(decomposed: DataFrame) -> DataFrame:
    """Vector and text part of each person's score, and how sure the match is."""
    best = F.max(F.when(F.col("place") == 1, F.when(F.col("vec_ok") & F.col("fts_ok"), "both")
                        .when(F.col("vec_ok"), "meaning").otherwise("words")))
    return decomposed.groupBy("query_id", "emp_id").agg(
        F.sum("vec_share").alias("vector_part"), F.sum("fts_share").alias("text_part"), best.alias("confidence")
    )


def outcome_flags(queries: DataFrame, people: DataFrame, fts: DataFrame) -> DataFrame:
    """Per query: nobody found, and whether only vectors were used."""
    found = people.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_people"))
    text = fts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_text"))
    return queries.select("query_id").join(found, "query_id", "left").join(text, "query_id", "left").select(
        "query_id", F.coalesce("n_people", F.lit(0)).alias("n_people"),
        F.col("n_people").isNull().alias("no_result"), F.col("n_text").isNull().alias("vector_only"),
    )


def document_vectors(sections: DataFrame) -> DataFrame:
    """(doc_id, vec): renormalised mean of the document's unit section vectors."""
    return mean_vectors(sections.select("doc_id", unit("embedding").alias("u")), ["doc_id"], "u")


def person_vectors(sections: DataFrame, authors: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(emp_id, vec): document vectors averaged by role weight, renormalised."""
    d = document_vectors(sections).join(authors.select("doc_id", "emp_id", "role"), "doc_id")
    d = d.withColumn("w", D.role_weight("role", weights)).where("w > 0")
    return mean_vectors(d, ["emp_id"], "vec", "w")


def profile_similarity(queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """(query_id, emp_id, sim) for every person with a profile."""
    s = similarity.score_all(as_vectors(queries, "query_id", "qvec"), as_vectors(profiles, "emp_id", "vec"))
    return s.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("emp_id"), "sim")


def profile_position(sims: DataFrame) -> DataFrame:
    """Every person's place among all profiles for a query, with the population's upper median and maximum."""
    stats = sims.groupBy("query_id").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY sim DESC)").alias("median"),
        F.max("sim").alias("top"), F.count(F.lit(1)).alias("people"),
    )
    placed = rank_within(sims, ["query_id"], F.desc("sim"), "emp_id")
    return placed.join(stats, "query_id").select("query_id", "emp_id", "sim", "position", "people", "median", "top")


def max_fusion_rank(docs_scored: DataFrame, documents: DataFrame, authors: DataFrame, employees: DataFrame,
                    beta: float = 0.0, discount: float = PLANNED_DISCOUNT, queries: DataFrame | None = None) -> DataFrame:
    """Variant without fusion: best section score times role weight, planned projects discounted."""
    c = contributions(docs_scored, documents, authors, employees, queries, planned_discount=discount)
    return person_scores(c, beta)
