"""People alike: similar profiles, and the network around a person."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowhow import constants as K
from knowhow.functions import derive as D
from knowhow.operators import similarity
from knowhow.session import cut_lineage, rank_within


def document_counts(authors: DataFrame) -> DataFrame:
    return authors.groupBy("emp_id").agg(F.count_distinct("doc_id").alias("n_docs"))


def shared_documents(authors: DataFrame, egos: DataFrame | None = None) -> DataFrame:
    """(emp_id, other_id, shared): documents two people have in common, both directions.

    With ``egos`` only their pairs are built, which keeps the join linear in the egos' documents.
    """
    a = authors.select("emp_id", "doc_id")
    left = a if egos is None else a.join(egos.select("emp_id"), "emp_id", "left_semi")
    left = cut_lineage(left.distinct())
    a = left if egos is None else a.join(left.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    other = a.select(F.col("emp_id").alias("other_id"), "doc_id")
    return left.join(other, "doc_id").where("emp_id <> other_id").groupBy("emp_id", "other_id").agg(
        F.count(F.lit(1)).alias("shared")
    )


def overlap(authors: DataFrame, egos: DataFrame | None = None) -> DataFrame:
    """(emp_id, other_id, shared, overlap): Jaccard overlap of the documents of people who share any."""
    n = document_counts(authors)
    s = shared_documents(authors, egos).join(n, "emp_id").withColumnRenamed("n_docs", "n1")
    s = s.join(n.select(F.col("emp_id").alias("other_id"), F.col("n_docs").alias("n2")), "other_id")
    return s.select(
        "emp_id", "other_id", "shared", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("overlap")
    )


def similar_people(egos: DataFrame, profiles: DataFrame, employees: DataFrame, authors: DataFrame,
                   min_sim: float = K.SIMILAR_MIN, top_n: int = K.SIMILAR_TOP, same_dept: float = K.SAME_DEPT_FACTOR,
                   overlap_boost: float = K.OVERLAP_BOOST) -> tuple[DataFrame, DataFrame]:
    """(people, status): nearest profiles after the department and overlap factors; the cut-off applies last."""
    mine = egos.select("emp_id").join(profiles, "emp_id").select(F.col("emp_id").alias("id"), "vec")
    active = employees.where("is_active").select("emp_id")
    others = profiles.join(active, "emp_id").select(F.col("emp_id").alias("id"), "vec")
    # The factors raise a similarity by at most (1 + boost): nobody below this bound can pass.
    bound = min_sim / (1 + overlap_boost) - 1e-6
    p = similarity.pairs_between(mine, others, bound, drop_self=True).select(
        F.col("left_id").alias("emp_id"), F.col("right_id").alias("other_id"), "sim"
    )
    e = employees.select("emp_id", F.col("dept_id").alias("d1"))
    o = employees.select(F.col("emp_id").alias("other_id"), F.col("dept_id").alias("d2"))
    p = p.join(e, "emp_id").join(o, "other_id").join(overlap(authors, egos), ["emp_id", "other_id"], "left")
    p = p.na.fill(0, ["shared"]).na.fill(0.0, ["overlap"]).withColumn("same_dept", F.col("d1") == F.col("d2"))
    p = p.withColumn(
        "score",
        F.col("sim") * F.when(F.col("same_dept"), same_dept).otherwise(1.0) * (1 + overlap_boost * (1 - F.col("overlap"))),
    ).drop("d1", "d2")
    passed = p.where(F.col("score") >= min_sim)
    w = Window.partitionBy("emp_id").orderBy(F.desc("score"), "other_id")
    people = passed.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_n)
    counts = passed.groupBy("emp_id").agg(F.count(F.lit(1)).alias("passed"))
    pool = others.agg(F.count(F.lit(1)).alias("pool")).withColumn("_one", F.lit(1))
    has = profiles.select("emp_id").withColumn("has", F.lit(True))
    status = egos.select("emp_id").join(has, "emp_id", "left").join(employees.select("emp_id", "is_active"), "emp_id", "left")
    status = status.join(counts, "emp_id", "left").na.fill(0, ["passed"]).withColumn("_one", F.lit(1)).join(pool, "_one")
    candidates = F.when(F.col("has").isNull(), F.lit(0)).otherwise(F.col("pool") - F.col("is_active").cast("int"))
    status = status.select(
        "emp_id", candidates.alias("candidates"), "passed",
        F.when(F.col("has").isNull(), "no_profile").when(F.col("passed") > 0, "ok").otherwise("none").alias("status"),
    )
    return people, status


def shared_terms(counts: DataFrame, pairs: DataFrame, ignore: DataFrame | None = None, top_n: int = 5, pool: int = 200) -> DataFrame:
    """Words two texts share, by the smaller of the two counts. ``counts``: (emp_id, term, n); ``pairs``: (emp_id, other_id)."""
    w = Window.partitionBy("emp_id").orderBy(F.desc("n"), "term")
    top = counts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= pool).drop("rk")
    if ignore is not None:
        top = top.join(ignore, "term", "left_anti")
    a = pairs.join(top, "emp_id").withColumnRenamed("n", "n1")
    b = top.select(F.col("emp_id").alias("other_id"), "term", F.col("n").alias("n2"))
    both = a.join(b, ["other_id", "term"]).withColumn("n", F.least("n1", "n2"))
    w = Window.partitionBy("emp_id", "other_id").orderBy(F.desc("n"), "term")
    return both.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_n).select(
        "emp_id", "other_id", "term", "n", "position"
    )


# ---- network -------------------------------------------------------------------------------------------------

def organisation_stopwords(departments: DataFrame) -> DataFrame:
    """Department, site and function names: being in the same unit is not a shared theme."""
    d = departments.select("dept_name", D.dept_site().alias("site"), D.dept_func().alias("func"))
    words = F.array(
        F.col("dept_name"), F.regexp_replace("dept_name", " ", ""), F.col("func"),
        F.concat("func", F.lit("部")), F.concat("func", F.lit("課")), F.col("site"),
        *[F.lit(w) for w in K.PLACE_WORDS],
    )
    return d.select(F.explode(words).alias("term")).where(F.col("term").isNotNull()).distinct()


def document_weights(doc_terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(doc_id, term, w): (1 + ln n) * (ln((N + 1) / (df + 1)) + 1).

    ``doc_terms``: (doc_id, term, n), one row per document and term. ``n_docs``: one row with the number of all documents.
    """
    df = doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = n_docs.withColumn("_one", F.lit(1))
    idf = df.withColumn("_one", F.lit(1)).join(total, "_one").select(
        "term", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )
    return doc_terms.join(idf, "term").select("doc_id", "term", ((1 + F.log("n")) * F.col("idf")).alias("w"))


def _raw_person_terms(weights: DataFrame, authors: DataFrame) -> DataFrame:
    return authors.select("doc_id", "emp_id").join(weights, "doc_id").groupBy("emp_id", "term").agg(F.sum("w").alias("raw"))


def _lengths(raw: DataFrame) -> DataFrame:
    return raw.groupBy("emp_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))


def person_lengths(weights: DataFrame, authors: DataFrame) -> DataFrame:
    """(emp_id, length) of the people's term rows; longer than 0."""
    return _lengths(_raw_person_terms(weights, authors)).where("length > 0")


def person_terms(doc_terms: DataFrame, authors: DataFrame, n_docs: DataFrame, materialise: bool = False,
                 weights: DataFrame | None = None) -> DataFrame:
    """(emp_id, term, weight): TF-IDF over the person's documents, unit length per person.

    Terms are weighted per document first, so that only one aggregation runs at person level; ``materialise``
    writes its result once for callers that read the table several times. ``weights`` may hold the weighted terms already.
    """
    raw = _raw_person_terms(document_weights(doc_terms, n_docs) if weights is None else weights, authors)
    raw = cut_lineage(raw) if materialise else raw
    return raw.join(_lengths(raw), "emp_id").select(
        "emp_id", "term", F.when(F.col("length") > 0, F.col("raw") / F.col("length")).otherwise(0.0).alias("weight")
    )


def _match(mine: DataFrame, rows: DataFrame, item: str, small: int, salt: int = 8) -> DataFrame:
    """Join the egos' term rows with ``rows`` by term.

    The egos' rows are counted: a short list is sent to all tasks, so that the long side stays where it is. A longer
    list is joined by term; as a common term has very many rows, they are spread over ``salt`` sub-keys by item.
    """
    if mine.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(mine), "term")
    mine = mine.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64(item), F.lit(salt)).cast("int")).join(mine, ["term", "_s"])


def text_closeness(egos: DataFrame, weights: DataFrame, authors: DataFrame, lengths: DataFrame | None = None,
                   small: int = 1_000_000) -> DataFrame:
    """(emp_id, other_id, sim): the cosine of ``term_closeness`` without a table of all people's terms.

    A person's row is the sum of their documents' rows, so the egos are multiplied with documents and the products
    summed per person; people's term rows are only needed for their lengths. ``weights`` (see
    ``document_weights``) is read twice or more and should be materialised; so should ``lengths`` (see ``person_lengths``).
    """
    lengths = cut_lineage(person_lengths(weights, authors)) if lengths is None else lengths
    mine = _raw_person_terms(weights, authors.join(egos.select("emp_id"), "emp_id", "left_semi"))
    dots = _match(mine, weights, "doc_id", small).groupBy("emp_id", "doc_id").agg(F.sum(F.col("raw") * F.col("w")).alias("dot"))
    other = authors.select(F.col("emp_id").alias("other_id"), "doc_id")
    pairs = dots.join(other, "doc_id").where("emp_id <> other_id").groupBy("emp_id", "other_id").agg(F.sum("dot").alias("dot"))
    pairs = pairs.join(lengths.withColumnRenamed("length", "l1"), "emp_id").join(
        lengths.select(F.col("emp_id").alias("other_id"), F.col("length").alias("l2")), "other_id"
    )
    return pairs.select("emp_id", "other_id", (F.col("dot") / F.col("l1") / F.col("l2")).alias("sim"))


def term_closeness(egos: DataFrame, people_terms: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(emp_id, other_id, sim): cosine of the egos' term rows with everybody's, from a materialised table of them."""
    mine = people_terms.join(egos.select("emp_id"), "emp_id", "left_semi").select("emp_id", "term", F.col("weight").alias("w1"))
    all_ = people_terms.select(F.col("emp_id").alias("other_id"), "term", F.col("weight").alias("w2"))
    both = _match(mine, all_, "other_id", small)
    return both.where("emp_id <> other_id").groupBy("emp_id", "other_id").agg(F.sum(F.col("w1") * F.col("w2")).alias("sim"))


def population(employees: DataFrame, authors: DataFrame, profiles: DataFrame) -> DataFrame:
    """Active people who wrote something or have a profile."""
    ids = authors.select("emp_id").unionByName(profiles.select("emp_id")).distinct()
    return employees.where("is_active").join(ids, "emp_id", "left_semi")


def closeness_level(pairs: DataFrame, employees: DataFrame, departments: DataFrame, shared: DataFrame) -> DataFrame:
    """Adds level 0-5 and shared: worked together, same department, site, function, kind of unit, different."""
    d = departments.select("dept_id", D.dept_site().alias("site"), D.dept_func().alias("func"), "dept_type")
    e = employees.select("emp_id", "dept_id").join(d, "dept_id")
    a = e.select("emp_id", *[F.col(c).alias(f"a_{c}") for c in ("dept_id", "site", "func", "dept_type")])
    b = e.select(F.col("emp_id").alias("other_id"), *[F.col(c).alias(f"b_{c}") for c in ("dept_id", "site", "func", "dept_type")])
    p = pairs.join(a, "emp_id").join(b, "other_id").join(shared, ["emp_id", "other_id"], "left").na.fill(0, ["shared"])
    level = (
        F.when(F.col("shared") > 0, 0)
        .when(F.col("a_dept_id") == F.col("b_dept_id"), 1)
        .when(F.col("a_site") == F.col("b_site"), 2)
        .when(F.col("a_func") == F.col("b_func"), 3)
        .when(F.col("a_dept_type") == F.col("b_dept_type"), 4)
        .otherwise(5)
    )
    return p.withColumn("level", level).select(*pairs.columns, "shared", "level")


def network_weights(t: float) -> tuple[float, float, float, float]:
    """Slider 0 (known people) .. 1 (new encounters) -> weights of profile, theme, text, acquaintance."""
    return 0.30 + 0.10 * t, 0.175 + 0.05 * t, 0.125 + 0.05 * t, 0.30 - 0.60 * t


def relative_profile(egos: DataFrame, people: DataFrame, profiles: DataFrame) -> DataFrame:
    """(emp_id, other_id, prof, prof_rel): 0 at the candidates' median similarity, 1 at the maximum."""
    p = profiles.join(people.select("emp_id"), "emp_id", "left_semi").select(F.col("emp_id").alias("id"), "vec")
    mine = p.join(egos.select(F.col("emp_id").alias("id")), "id", "left_semi")
    s = similarity.score_all(mine, p, drop_self=True).select(
        F.col("left_id").alias("emp_id"), F.col("right_id").alias("other_id"), F.col("sim").alias("prof")
    )
    s = cut_lineage(s)  # read twice: for the median and for the result
    # Rounded similarities bound the state of the exact median.
    stats = s.groupBy("emp_id").agg(F.percentile("prof", 0.5).alias("base"), F.max("prof").alias("top"))
    rel = (F.col("prof") - F.col("base")) / F.greatest(F.col("top") - F.col("base"), F.lit(1e-9))
    return s.join(stats, "emp_id").select(
        "emp_id", "other_id", "prof", F.least(F.greatest(rel, F.lit(0.0)), F.lit(1.0)).alias("prof_rel")
    )


def organisation_closeness(egos: DataFrame, people: DataFrame, employees: DataFrame, departments: DataFrame,
                           authors: DataFrame, spread: int = 64) -> DataFrame:
    """(emp_id, other_id, shared, level) for every ego and every other person of the population."""
    ids = people.select("emp_id")
    mine = egos.select("emp_id").join(ids, "emp_id", "left_semi")
    # Everybody is compared with each ego, also people who share nothing with them. People are spread over
    # sub-keys and the egos repeated for each, so the pairs form evenly in all tasks.
    pairs = mine.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).join(
        ids.select(F.col("emp_id").alias("other_id"), F.pmod(F.xxhash64("emp_id"), F.lit(spread)).cast("int").alias("_s")), "_s"
    ).drop("_s").where("emp_id <> other_id")
    authors = authors.join(ids, "emp_id", "left_semi")
    return closeness_level(pairs, employees, departments, shared_documents(authors, mine))


def pair_measures(egos: DataFrame, people: DataFrame, profiles: DataFrame, theme: DataFrame, text: DataFrame,
                  employees: DataFrame, departments: DataFrame, authors: DataFrame, use_profile: bool = True,
                  spread: int = 64) -> DataFrame:
    """One row per ego and other person of the population with all measures of closeness.

    ``theme`` and ``text`` are (emp_id, other_id, sim) frames of the egos' term closeness.
    """
    ids = people.select("emp_id")
    mine = egos.select("emp_id").join(ids, "emp_id", "left_semi")
    p = organisation_closeness(egos, people, employees, departments, authors, spread)
    keys = ["emp_id", "other_id"]
    th = theme.withColumnRenamed("sim", "theme").join(
        ids.select(F.col("emp_id").alias("other_id")), "other_id", "left_semi")
    tx = text.withColumnRenamed("sim", "text").join(
        ids.select(F.col("emp_id").alias("other_id")), "other_id", "left_semi")
    p = p.join(th, keys, "left").join(tx, keys, "left")
    if use_profile:
        p = p.join(relative_profile(mine, people, profiles), keys, "left")
    else:
        p = p.withColumn("prof", F.lit(0.0)).withColumn("prof_rel", F.lit(0.0))
    p = p.na.fill(0.0, ["theme", "text", "prof", "prof_rel"])
    top = p.groupBy("emp_id").agg(F.max("theme").alias("max_theme"), F.max("text").alias("max_text"))
    return p.join(top, "emp_id").withColumn(
        "theme_rel", F.col("theme") / F.greatest("max_theme", F.lit(1e-9))
    ).withColumn("text_rel", F.col("text") / F.greatest("max_text", F.lit(1e-9)))


def neighbors(measures: DataFrame, t: float = K.NETWORK_T, known_range: int = K.NETWORK_RANGE, top_n: int = K.NETWORK_TOP,
              use_profile: bool = True, by: tuple[str, ...] = ("emp_id",)) -> DataFrame:
    """The closest people per ego, with the weighted parts and the surprise flag."""
    w0, w1, w2, w3 = network_weights(t)
    if not use_profile:
        k = 1.0 / (1.0 - w0)
        w0, w1, w2, w3 = 0.0, w1 * k, w2 * k, w3 * k
    known = F.lit(0.0)
    for lv, strength in enumerate(K.LEVEL_STRENGTH):
        if lv <= known_range or lv == 0:
            known = F.when(F.col("level") == lv, strength).otherwise(known)
    m = (
        measures.withColumn("part_profile", w0 * F.col("prof_rel"))
        .withColumn("part_theme", w1 * F.col("theme_rel"))
        .withColumn("part_text", w2 * F.col("text_rel"))
        .withColumn("part_known", w3 * known)
    )
    m = m.withColumn("score", F.round(F.col("part_profile") + F.col("part_theme") + F.col("part_text") + F.col("part_known"), 9))
    surprise = (
        F.lit(use_profile) & (F.col("prof_rel") >= K.SURPRISE_PROFILE_MIN)
        & (F.col("theme_rel") < K.SURPRISE_THEME_MAX) & (F.col("level") > known_range)
    )
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return m.withColumn("surprise", surprise).withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_n)


def with_status(egos: DataFrame, people: DataFrame, nbrs: DataFrame) -> DataFrame:
    """The neighbours with a status; every ego has a row: no_docs for those outside the population, ok for the others.

    An ego without neighbours has one row with nulls.
    """
    e = egos.select("emp_id").distinct().join(people.select("emp_id", F.lit("ok").alias("status")).distinct(), "emp_id", "left")
    e = e.withColumn("status", F.coalesce("status", F.lit("no_docs")))
    return e.join(nbrs, "emp_id", "left").select(*nbrs.columns, "status")


def shared_words(pairs: DataFrame, theme: DataFrame, top_n: int = 3) -> DataFrame:
    """Words both people stand for, by the smaller of the two weights."""
    a = pairs.select("emp_id", "other_id").join(theme, "emp_id").withColumnRenamed("weight", "w1")
    b = theme.select(F.col("emp_id").alias("other_id"), "term", F.col("weight").alias("w2"))
    both = a.join(b, ["other_id", "term"]).withColumn("both", F.round(F.least("w1", "w2"), 9)).where("both > 0")
    w = Window.partitionBy("emp_id", "other_id").orderBy(F.desc("both"), "term")
    return both.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_n).select(
        "emp_id", "other_id", "term", "both", "position"
    )


def top_terms(theme: DataFrame, top_n: int = 5) -> DataFrame:
    w = Window.partitionBy("emp_id").orderBy(F.desc(F.round("weight", 9)), "term")
    return theme.where("weight > 0").withColumn("position", F.row_number().over(w)).where(F.col("position") <= top_n)


def person_counts(authors: DataFrame, documents: DataFrame) -> DataFrame:
    """Finished projects, accepted proposals and other documents per person."""
    d = documents.select("doc_id", "doc_type", D.is_proven().alias("proven"))
    a = authors.select("emp_id", "doc_id").join(d, "doc_id")
    return a.groupBy("emp_id").agg(
        F.count(F.when(F.col("proven") & (F.col("doc_type") == "project"), 1)).alias("done_projects"),
        F.count(F.when(F.col("proven") & (F.col("doc_type") == "proposal"), 1)).alias("accepted_proposals"),
        F.count(F.when(~F.col("proven"), 1)).alias("others"), F.count(F.lit(1)).alias("total"),
    )


def ordered_documents(pairs: DataFrame, authors: DataFrame, documents: DataFrame) -> DataFrame:
    """A neighbour's documents seen from the ego: shared ones first, then proven ones, then the newest."""
    d = documents.select("doc_id", D.is_proven().alias("proven"), D.doc_date().alias("doc_date"))
    a = authors.select(F.col("emp_id").alias("other_id"), "doc_id")
    mine = authors.select("emp_id", "doc_id", F.lit(True).alias("mine"))
    x = pairs.select("emp_id", "other_id").join(a, "other_id").join(mine, ["emp_id", "doc_id"], "left").join(d, "doc_id")
    x = x.withColumn("shared", F.coalesce("mine", F.lit(False)))
    order = (F.desc("shared"), F.desc("proven"), F.desc("doc_date"), "doc_id")
    return rank_within(x, ["emp_id", "other_id"], *order).select(
        "emp_id", "other_id", "position", "doc_id", "shared", "proven", "doc_date"
    )


def neighbour_edges(nbrs: DataFrame, theme: DataFrame, pair_min: float = K.PAIR_MIN) -> DataFrame:
    """Edges among one ego's neighbours whose themes are close. A neighbour list is at most top_n long."""
    n = nbrs.select("emp_id", "other_id")
    pairs = n.withColumnRenamed("other_id", "a").join(n.withColumnRenamed("other_id", "b"), "emp_id").where("a < b")
    ta = theme.select(F.col("emp_id").alias("a"), "term", F.col("weight").alias("w1"))
    tb = theme.select(F.col("emp_id").alias("b"), "term", F.col("weight").alias("w2"))
    sims = pairs.select("a", "b").distinct().join(ta, "a").join(tb, ["b", "term"]).groupBy("a", "b").agg(
        F.sum(F.col("w1") * F.col("w2")).alias("sim")
    )
    return pairs.join(sims.where(F.col("sim") >= pair_min), ["a", "b"]).select("emp_id", "a", "b", "sim")


def main_reason():
    """Largest part of a neighbour's score; the profile only when it counts at all. Ties go to the earlier part."""
    docs = F.when(F.col("part_theme") >= F.col("part_text"), "theme").otherwise("text")
    return F.when(
        (F.col("part_profile") > 0) & (F.col("part_profile") >= F.col("part_theme"))
        & (F.col("part_profile") >= F.col("part_text")), "profile",
    ).otherwise(docs)
