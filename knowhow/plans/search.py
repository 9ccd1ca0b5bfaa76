"""Retrieval and ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from knowhow.functions import text as T
from knowhow.functions.vector import dot, norm, unit
from knowhow.operators import fulltext, inverted, ranking as R, similarity
from knowhow.plans.registry import query, view
from knowhow.session import cut_lineage
from knowhow.sources.corpus import Corpus

VEC_MIN = 0.2  # the corpus' vectors are far less alike than those of a text model


def r(c, digits=6):
    return F.round(c, digits).alias(c) if isinstance(c, str) else F.round(c, digits)


# ---- shared pieces -------------------------------------------------------------------------------------------

def query_terms(c: Corpus):
    return fulltext.query_terms(c.queries, T.query_terms("text"))


def vec(c: Corpus, k=100):
    return c.once(("vec", k), lambda: R.vector_search(c.queries, c.sections, k))


def fts(c: Corpus, n=100):
    return c.once(("fts", n), lambda: inverted.best(c.index, query_terms(c), n))


def hybrid(c: Corpus, **opts):
    return R.gated_hybrid(vec(c), fts(c), **{"vec_min": VEC_MIN, **opts})


def docs(c: Corpus, h=None):
    return R.doc_scores((h if h is not None else hybrid(c)).select("query_id", "section_id", "score"), c.section_documents)


def contribs(c: Corpus, h=None, queries=None, **opts):
    return R.contributions(docs(c, h), c.documents, c.authors, c.employees, queries, **opts)


def people(c: Corpus, **opts):
    return R.person_scores(contribs(c, **opts))


def profile_sims(c: Corpus):
    return R.profile_similarity(c.queries, c.profiles)


view("v_sims", """
SELECT q.query_id, s.section_id, s.doc_id, s.section_role, round(list_dot_product(q.u, s.u), 6) AS sim FROM fx_query_unit q CROSS JOIN fx_unit s""")
view("v_vec", """
SELECT query_id, section_id, CAST(round(CAST(sim AS DECIMAL(9, 6)), 4) AS DOUBLE) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, section_id) AS rank FROM v_sims) WHERE rank <= 100""")
view("v_section_terms", "SELECT doc_id AS section_id, doc_id // 4 AS doc_id, term, count(*) AS n FROM v_terms GROUP BY ALL")
view("v_query_terms", "SELECT DISTINCT doc_id AS query_id, term FROM v_q_terms")
view("v_fts", """
SELECT query_id, section_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM (
    SELECT q.query_id, t.section_id, CAST(sum(t.n) AS DOUBLE) AS score FROM v_query_terms q JOIN v_section_terms t USING (term)
    GROUP BY q.query_id, t.section_id)) WHERE rank <= 100""")
HYBRID = """
SELECT *, vec_part + fts_part AS score FROM (
  SELECT *, CASE WHEN vec_ok THEN wv / (60 + vec_rank) ELSE 0.0 END AS vec_part,
    CASE WHEN fts_ok THEN wf / (60 + fts_rank) ELSE 0.0 END AS fts_part FROM (
  SELECT query_id, section_id, vec_rank, vec_cos, fts_rank, fts_score, fts_used,
    coalesce(vec_cos >= {vec_min}, false) AS vec_ok, coalesce(fts_score >= {fts_min}, false) AS fts_ok,
    CASE WHEN fts_used THEN CAST(1 - {w} AS DOUBLE) ELSE 1.0::DOUBLE END AS wv, CASE WHEN fts_used THEN {w}::DOUBLE ELSE 0.0::DOUBLE END AS wf
  FROM (SELECT coalesce(v.query_id, f.query_id) AS query_id, coalesce(v.section_id, f.section_id) AS section_id,
      v.rank AS vec_rank, v.score AS vec_cos, f.rank AS fts_rank, f.score AS fts_score,
      coalesce(v.query_id, f.query_id) IN (SELECT query_id FROM v_fts) AS fts_used
    FROM v_vec v FULL JOIN v_fts f ON v.query_id = f.query_id AND v.section_id = f.section_id)))
WHERE vec_ok OR fts_ok"""
view("v_hybrid", HYBRID.format(vec_min=VEC_MIN, fts_min=8.0, w=0.5))
DOCS = """
SELECT query_id, doc_id, score, section_id FROM (
  SELECT h.query_id, s.doc_id, h.score, h.section_id,
    row_number() OVER (PARTITION BY h.query_id, s.doc_id ORDER BY h.score DESC, h.section_id) AS rn
  FROM {h} h JOIN fx_sections_base s USING (section_id)) WHERE rn = 1"""
view("v_docs", DOCS.format(h="v_hybrid"))
view("v_doc_info", """
SELECT doc_id, doc_type, result, pj_status,
  coalesce((doc_type = 'project' AND pj_status = 'done') OR (doc_type = 'proposal' AND result = 'accepted'), false) AS proven,
  year(CASE WHEN doc_type = 'project' THEN started_at ELSE submitted_at END) AS year FROM fx_documents""")
CONTRIB = """
SELECT d.query_id, a.emp_id, e.dept_id, d.doc_id, d.section_id, a.role, w.w AS role_weight, d.score * w.w * {factor} AS contribution, i.proven, i.year
FROM {docs} d JOIN v_doc_info i USING (doc_id) JOIN fx_authors a USING (doc_id) JOIN fx_employees e USING (emp_id)
JOIN fx_role_weight w USING (role) JOIN fx_queries q ON q.query_id = d.query_id WHERE e.is_active AND {where}"""
view("v_contrib", CONTRIB.format(factor="1", docs="v_docs", where="true"))
NUMBERED = """
SELECT *, row_number() OVER (PARTITION BY query_id, emp_id ORDER BY contribution DESC, doc_id) AS place FROM {c}"""
view("v_numbered", NUMBERED.format(c="v_contrib"))
PEOPLE = """
SELECT query_id, emp_id, dept_id, sum(CASE WHEN place = 1 THEN contribution ELSE {beta} * contribution END) AS score,
  bool_or(place = 1 AND proven) AS proven FROM {n} WHERE place <= 2 GROUP BY query_id, emp_id, dept_id"""
view("v_people", PEOPLE.format(beta="0.3::DOUBLE", n="v_numbered"))
view("v_psims", """
SELECT q.query_id, p.emp_id, round(list_dot_product(q.u, p.u), 6) AS sim FROM fx_query_unit q CROSS JOIN fx_profiles p""")
FRAMES = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, frame ORDER BY score DESC, emp_id) AS position
  FROM (SELECT *, CASE WHEN proven THEN 'proven' ELSE 'hidden' END AS frame FROM {p})) WHERE position <= 5"""


# ---- R1 - R5: retrieval --------------------------------------------------------------------------------------

@query("R1_l2_normalise", """
SELECT section_id, round(list_dot_product(u, u), 6) AS length, round(u[1], 6) AS first, round(list_sum(u), 6) AS total FROM fx_unit""")
def _(c):
    s = c.sections.select("section_id", unit("embedding").alias("u"))
    return s.select(
        "section_id", F.round(dot("u", "u"), 6).alias("length"), F.round(F.col("u")[0], 6).alias("first"),
        F.round(F.aggregate("u", F.lit(0.0), lambda a, b: a + b), 6).alias("total"),
    )


@query("R2_vector_top_k", "SELECT query_id, section_id, score, rank FROM v_vec")
def _(c):
    return vec(c).select("query_id", "section_id", "score", F.col("rank").cast("long").alias("rank"))


def approximate(c):
    theirs = R.as_vectors(c.section_vectors, "section_id", "embedding")
    width = c.table("embeddings").agg(F.max(F.size("embedding"))).first()[0] or 1
    hits = similarity.approximate_top_k(
        R.as_vectors(c.queries, "query_id", "qvec"), theirs, 10, similarity.build_index(theirs, width)
    )
    return hits.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("section_id"), "sim", F.col("rank").cast("long").alias("rank"))


@query("R3_approximate_top_k")
def _(c):
    return approximate(c)


@query("R3_approximate_nearest", """
SELECT query_id, section_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, section_id) AS rank FROM v_sims) WHERE rank <= 2""")
def _(c):
    return approximate(c).where("rank <= 2").select("query_id", "section_id", "sim")


@query("R3_recall", """
SELECT query_id, 10::BIGINT AS found, count(*) FILTER (sim >= 0.4) AS near, true AS mean_recall_090
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, section_id) AS rank FROM v_sims) WHERE rank <= 10 GROUP BY query_id""")
def _(c):
    """Per query how many of its ten nearest are closer than unrelated vectors are, and whether nine tenths of those are found."""
    got = cut_lineage(approximate(c).select("query_id", "section_id"))
    exact = vec(c, 10).where("score >= 0.4").select("query_id", "section_id")
    hits = exact.join(got.withColumn("hit", F.lit(1)), ["query_id", "section_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("near"), F.count("hit").alias("hits"))
    q = got.groupBy("query_id").agg(F.count(F.lit(1)).alias("found")).join(hits, "query_id", "left").na.fill(0)
    q = cut_lineage(q.withColumn("_one", F.lit(1)))
    mean = q.groupBy("_one").agg((F.sum("hits") >= 0.9 * F.sum("near")).alias("mean_recall_090"))
    return q.join(mean, "_one").select("query_id", "found", "near", "mean_recall_090")


@query("R4_fulltext_any_term", "SELECT query_id, section_id, score, rank FROM v_fts")
def _(c):
    return fts(c).select("query_id", "section_id", "score", F.col("rank").cast("long").alias("rank"))


GRAMS = r"""
SELECT {k}, unnest(list_transform(list_zip(ch, ch[2:]), lambda p: p[1] || p[2])) AS term FROM (
  SELECT {k}, string_split(regexp_replace({t}, '\s+', '', 'g'), '') AS ch FROM {s})"""
view("v_grams", "SELECT section_id, term, count(*) AS n FROM (" + GRAMS.format(k="section_id", t="body", s="fx_sections_base") + ") WHERE term IS NOT NULL GROUP BY ALL")
view("v_query_grams", "SELECT DISTINCT query_id, term FROM (" + GRAMS.format(k="query_id", t="text", s="fx_queries") + ") WHERE term IS NOT NULL")
BM25 = r"""
SELECT q.query_id, g.section_id, sum(ln(1 + (w.nn - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * g.n * 2.5::DOUBLE / (g.n + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.len / w.avg_len))) AS score
FROM {q} q JOIN v_grams g USING (term) JOIN (SELECT term, count(*) AS df FROM v_grams GROUP BY term) d USING (term)
JOIN (SELECT section_id, greatest(length(regexp_replace(body, '\s+', '', 'g')) - 1, 0) AS len FROM fx_sections_base) l USING (section_id)
CROSS JOIN (SELECT count(*) AS nn, avg(greatest(length(regexp_replace(body, '\s+', '', 'g')) - 1, 0)) AS avg_len FROM fx_sections_base) w
GROUP BY q.query_id, g.section_id"""
view("v_bm25", BM25.replace("{q}", "v_query_grams"))
view("v_word_probes", "SELECT query_id, min(term) AS text FROM v_query_terms GROUP BY query_id")
view("v_word_probe_grams", "SELECT DISTINCT query_id, term FROM (" + GRAMS.format(k="query_id", t="text", s="v_word_probes") + ") WHERE term IS NOT NULL")
view("v_word_probe", BM25.replace("{q}", "v_word_probe_grams"))
BM25_TOP = """
SELECT query_id, section_id, score, rank FROM (
  SELECT query_id, section_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, section_id) AS rank FROM {s})
WHERE rank <= {k}"""


@query("R5_bm25_character_bigrams", "SELECT query_id, section_id, round(score, 6) AS score FROM v_bm25")
def _(c):
    s = fulltext.bm25(c.sections, c.queries.select("query_id", "text"))
    return s.select("query_id", "section_id", r("score"))


@query("R5_bm25_top_k", BM25_TOP.format(s="v_bm25", k=100))
def _(c):
    s = fulltext.bm25(c.sections, c.queries, k=100)
    return s.select("query_id", "section_id", r("score"), F.col("rank").cast("long").alias("rank"))


@query("R5_keyword_probe", BM25_TOP.format(s="v_word_probe", k=5))
def _(c):
    """The best sections for one word of each query alone."""
    probes = query_terms(c).groupBy("query_id").agg(F.min("term").alias("text"))
    s = fulltext.bm25(c.sections, probes, k=5)
    return s.select("query_id", "section_id", r("score"), F.col("rank").cast("long").alias("rank"))


# ---- R6 - R9: fusion -----------------------------------------------------------------------------------------

@query("R6_rrf", """
SELECT query_id, section_id, round(sum(p), 10) AS score FROM (
  SELECT query_id, section_id, 1.0::DOUBLE / (60 + rank) AS p FROM v_vec UNION ALL SELECT query_id, section_id, 0.7::DOUBLE / (60 + rank) FROM v_fts)
GROUP BY query_id, section_id""")
def _(c):
    return R.rrf([(vec(c), 1.0), (fts(c), 0.7), (vec(c), 0.0)]).select("query_id", "section_id", r("score", 10))


@query("R7_weighted_hybrid", """
SELECT query_id, section_id, round(sum(p), 10) AS score FROM (
  SELECT query_id, section_id, 0.4::DOUBLE / (60 + rank) AS p FROM v_vec UNION ALL SELECT query_id, section_id, 0.6::DOUBLE / (60 + rank) FROM v_fts)
GROUP BY query_id, section_id""")
def _(c):
    return R.rrf([(vec(c), 0.4), (fts(c), 0.6)]).select("query_id", "section_id", r("score", 10))


@query("R8_gated_hybrid", """
SELECT query_id, section_id, vec_ok, fts_ok, round(vec_part, 10) AS vec_part, round(fts_part, 10) AS fts_part, round(score, 10) AS score FROM v_hybrid""")
def _(c):
    return hybrid(c).select(
        "query_id", "section_id", "vec_ok", "fts_ok", r("vec_part", 10), r("fts_part", 10), r("score", 10)
    )


@query("R9_section_to_document", "SELECT query_id, doc_id, section_id, round(score, 10) AS score FROM v_docs")
def _(c):
    return docs(c).select("query_id", "doc_id", "section_id", r("score", 10))


# ---- R10 - R15: people ---------------------------------------------------------------------------------------

@query("R10_document_to_person", """
SELECT query_id, emp_id, doc_id, role, role_weight, round(contribution, 10) AS contribution FROM v_contrib""")
def _(c):
    return contribs(c).select("query_id", "emp_id", "doc_id", "role", "role_weight", r("contribution", 10))


view("v_contrib_recent", CONTRIB.format(
    factor="(1 - 0.05::DOUBLE * least(greatest(2026 - i.year, 0), 5))", docs="v_docs", where="true"))


@query("R11_recency", "SELECT query_id, emp_id, doc_id, round(contribution, 10) AS contribution FROM v_contrib_recent")
def _(c):
    return contribs(c, recency=0.05).select("query_id", "emp_id", "doc_id", r("contribution", 10))


@query("R12_person_score", "SELECT query_id, emp_id, round(score, 10) AS score FROM v_people")
def _(c):
    return people(c).select("query_id", "emp_id", r("score", 10))


view("v_best_doc", """
SELECT query_id, doc_id, max(sim) AS score, 0 AS section_id FROM v_sims GROUP BY query_id, doc_id""")
view("v_contrib_max", CONTRIB.format(
    factor="(CASE WHEN i.pj_status = 'planned' THEN 0.8::DOUBLE ELSE 1 END)", docs="v_best_doc",
    where="e.emp_id <> q.searcher").replace("i.year", "i.year, i.pj_status"))
view("v_numbered_max", NUMBERED.format(c="v_contrib_max"))
view("v_people_max", PEOPLE.format(beta="0.3::DOUBLE", n="v_numbered_max"))


@query("R13_max_with_planned_discount", "SELECT query_id, emp_id, round(score, 10) AS score FROM v_people_max")
def _(c):
    return max_people(c).select("query_id", "emp_id", r("score", 10))


def max_docs(c):
    """(query_id, doc_id, score, section_id): the best section's similarity; no section is named, as in the SQL."""
    sections = c.sections.where("doc_id is not null").select(F.col("section_id").alias("id"), F.col("doc_id").alias("grp"), F.col("embedding").alias("vec"))
    best = similarity.best_of_groups(R.as_vectors(c.queries, "query_id", "qvec"), sections)
    return c.once("max_docs", lambda: best.select(
        F.col("left_id").alias("query_id"), F.col("grp").alias("doc_id"), F.col("sim").alias("score"), F.lit(0).cast("long").alias("section_id")))


def max_people(c, beta=0.3):
    return R.max_fusion_rank(max_docs(c), c.documents, c.authors, c.employees, beta, queries=c.queries)


@query("R14_evidence", """
SELECT query_id, emp_id, place, doc_id, section_id, role, round(contribution, 6) AS contribution FROM v_numbered WHERE place <= 3""")
def _(c):
    return R.evidence(contribs(c)).select(
        "query_id", "emp_id", F.col("place").cast("long").alias("place"), "doc_id", "section_id", "role", "contribution"
    )


@query("R15_frames", "SELECT query_id, frame, position, emp_id, dept_id, round(score, 10) AS score FROM (" + FRAMES.format(p="v_people") + ")")
def _(c):
    return find_people(c)


def find_people(c):
    return R.frames(people(c)).select(
        "query_id", "frame", F.col("position").cast("long").alias("position"), "emp_id", "dept_id", r("score", 10)
    )


view("v_contrib_filtered", CONTRIB.format(
    factor="1", docs="v_docs",
    where="e.emp_id <> q.searcher AND i.year BETWEEN 1996 AND 1999 AND e.dept_id IN (0,1,2,3,4,5,6,7,8,9,10,11)"))


@query("P9_person_filters", "SELECT query_id, emp_id, doc_id, round(contribution, 10) AS contribution FROM v_contrib_filtered")
def _(c):
    return contribs(c, queries=c.queries, years=range(1996, 2000), depts=range(12)).select(
        "query_id", "emp_id", "doc_id", r("contribution", 10)
    )


# ---- R16 - R18: blend and diversity --------------------------------------------------------------------------

view("v_scaled", """
SELECT s.query_id, s.emp_id, s.sim, CASE WHEN m.ceil - m.floor > 0 THEN greatest(s.sim - m.floor, 0) / (m.ceil - m.floor) ELSE 0 END AS scaled
FROM v_psims s JOIN (
  SELECT query_id, max(CASE WHEN rn = n // 2 + 1 THEN sim END) AS floor, max(sim) AS ceil FROM (
    SELECT query_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim) AS rn, count(*) OVER (PARTITION BY query_id) AS n FROM v_psims)
  GROUP BY query_id) m USING (query_id)""")
BLEND = """
SELECT k.query_id, k.emp_id, e.dept_id, coalesce(p.score, 0) / t.top AS path, coalesce(s.scaled, 0) AS profile,
  {a} * (coalesce(p.score, 0) / t.top) + (1 - {a}) * coalesce(s.scaled, 0) AS score, coalesce(p.proven, false) AS proven
FROM (SELECT query_id, emp_id FROM {p} UNION
      SELECT n.query_id, n.emp_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY scaled DESC, emp_id) AS rk FROM v_scaled) n
      JOIN fx_employees e2 ON e2.emp_id = n.emp_id AND e2.is_active {extra} WHERE n.rk <= 50 AND n.scaled > 0) k
JOIN fx_employees e USING (emp_id) LEFT JOIN {p} p ON p.query_id = k.query_id AND p.emp_id = k.emp_id
LEFT JOIN v_scaled s ON s.query_id = k.query_id AND s.emp_id = k.emp_id
JOIN (SELECT query_id, max(score) AS top FROM {p} GROUP BY query_id) t ON t.query_id = k.query_id"""
view("v_blend", BLEND.format(a="0.8::DOUBLE", p="v_people", extra=""))


@query("R16_profile_blend", "SELECT query_id, emp_id, round(path, 6) AS path, round(profile, 6) AS profile, round(score, 6) AS score, proven FROM v_blend")
def _(c):
    b = R.blend_profiles(people(c), profile_sims(c), c.employees, 0.8)
    return b.select("query_id", "emp_id", r("path"), r("profile"), r("score"), "proven")


@query("R17_scaled_profile_similarity", "SELECT query_id, emp_id, sim, round(scaled, 6) AS scaled FROM v_scaled")
def _(c):
    return R.scale_similarity(profile_sims(c)).select("query_id", "emp_id", "sim", r("scaled"))


# The check re-picks greedily, one person per step, instead of using the closed form.
@query("R18_diversity", """
WITH RECURSIVE pool AS (SELECT query_id, CASE WHEN proven THEN 'proven' ELSE 'hidden' END AS frame, emp_id, dept_id, score FROM v_people),
pick AS (
  SELECT query_id, frame, 0 AS position, CAST(-1 AS BIGINT) AS emp_id, CAST(0 AS DOUBLE) AS score, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS depts
  FROM (SELECT DISTINCT query_id, frame FROM pool)
  UNION ALL
  SELECT query_id, frame, position, emp_id, score, used, depts FROM (
    SELECT k.query_id, k.frame, k.position + 1 AS position, p.emp_id, p.score, list_append(k.used, p.emp_id) AS used, list_append(k.depts, p.dept_id) AS depts,
      row_number() OVER (PARTITION BY k.query_id, k.frame
        ORDER BY p.score * pow(0.7::DOUBLE, len(list_filter(k.depts, lambda d: d = p.dept_id))) DESC, p.score DESC, p.emp_id) AS rn
    FROM pick k JOIN pool p ON p.query_id = k.query_id AND p.frame = k.frame AND NOT list_contains(k.used, p.emp_id) WHERE k.position < 5) WHERE rn = 1)
SELECT query_id, frame, CAST(position AS BIGINT) AS position, emp_id, round(score, 10) AS score FROM pick WHERE position > 0""")
def _(c):
    return R.frames(people(c), diversity=0.3).select(
        "query_id", "frame", F.col("position").cast("long").alias("position"), "emp_id", r("score", 10)
    )


# ---- R19 - R24: explanation ----------------------------------------------------------------------------------

view("v_decomp", """
SELECT n.*, h.vec_rank, h.fts_rank, h.vec_cos, h.fts_score, h.vec_ok, h.fts_ok, h.vec_part, h.fts_part, h.score AS total, round(n.contribution, 6) AS c6
FROM (SELECT * FROM v_numbered WHERE place <= 3) n JOIN v_hybrid h ON h.query_id = n.query_id AND h.section_id = n.section_id""")


@query("R19_score_decomposition", """
SELECT query_id, emp_id, place, doc_id, coalesce(vec_rank, 0) AS vec_rank, coalesce(fts_rank, 0) AS fts_rank, coalesce(vec_cos, -9) AS vec_cos,
  vec_ok, fts_ok, round(total, 10) AS section_score, round(c6 / total, 4) AS role_weight, place <= 2 AS counted FROM v_decomp""")
def _(c):
    h = hybrid(c)
    d = R.decompose(contribs(c, h), h)
    return d.select(
        "query_id", "emp_id", F.col("place").cast("long").alias("place"), "doc_id",
        F.coalesce(F.col("vec_rank").cast("long"), F.lit(0)).alias("vec_rank"),
        F.coalesce(F.col("fts_rank").cast("long"), F.lit(0)).alias("fts_rank"),
        F.coalesce("vec_cos", F.lit(-9.0)).alias("vec_cos"), "vec_ok", "fts_ok", r("section_score", 10),
        r("role_weight", 4), "counted",
    )


@query("R20_parts_and_confidence", """
SELECT query_id, emp_id, round(sum(c6 * vec_part / total * k), 10) AS vector_part, round(sum(c6 * fts_part / total * k), 10) AS text_part,
  max(CASE WHEN place = 1 THEN CASE WHEN vec_ok AND fts_ok THEN 'both' WHEN vec_ok THEN 'meaning' ELSE 'words' END END) AS confidence
FROM (SELECT *, CASE place WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS k FROM v_decomp) GROUP BY query_id, emp_id""")
def _(c):
    h = hybrid(c)
    p = R.person_parts(R.decompose(contribs(c, h), h))
    return p.select("query_id", "emp_id", r("vector_part", 10), r("text_part", 10), "confidence")


view("v_hybrid_strict", HYBRID.format(vec_min=0.86, fts_min=400.0, w=0.5))


@query("R21_no_result_flags", """
SELECT q.query_id, count(DISTINCT a.emp_id) AS n_people, count(DISTINCT a.emp_id) = 0 AS no_result,
  q.query_id NOT IN (SELECT query_id FROM v_fts) AS vector_only
FROM fx_queries q LEFT JOIN v_hybrid_strict h USING (query_id) LEFT JOIN fx_sections_base s USING (section_id)
LEFT JOIN (SELECT a.doc_id, a.emp_id FROM fx_authors a JOIN fx_employees e USING (emp_id) WHERE e.is_active) a USING (doc_id)
GROUP BY q.query_id""")
def _(c):
    h = hybrid(c, vec_min=0.86, fts_min=400.0)
    p = R.person_scores(contribs(c, h))
    return R.outcome_flags(c.queries, p, fts(c))


@query("R22_query_profile_similarity", "SELECT query_id, emp_id, sim FROM v_psims")
def _(c):
    return profile_sims(c).select("query_id", "emp_id", "sim")


@query("R23_person_vector_blend", """
SELECT query_id, emp_id, round(0.8::DOUBLE * p.score + 0.2::DOUBLE * s.sim, 10) AS score FROM v_people_max p JOIN v_psims s USING (query_id, emp_id)""")
def _(c):
    p = max_people(c).join(profile_sims(c), ["query_id", "emp_id"])
    return p.select("query_id", "emp_id", F.round(0.8 * F.col("score") + 0.2 * F.col("sim"), 10).alias("score"))


@query("R24_profile_position", """
SELECT s.query_id, s.emp_id, s.sim, s.position, s.people, m.median, s.top, b.best_note FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, emp_id) AS position, count(*) OVER (PARTITION BY query_id) AS people,
    max(sim) OVER (PARTITION BY query_id) AS top FROM v_psims) s
JOIN (SELECT query_id, max(CASE WHEN rn = n // 2 + 1 THEN sim END) AS median FROM (
    SELECT query_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim) AS rn, count(*) OVER (PARTITION BY query_id) AS n FROM v_psims)
  GROUP BY query_id) m USING (query_id)
JOIN (SELECT q.query_id, a.emp_id, max(round(list_dot_product(q.u, d.u), 6)) AS best_note
  FROM fx_doc_vec d JOIN fx_authors a USING (doc_id) CROSS JOIN fx_query_unit q GROUP BY q.query_id, a.emp_id) b USING (query_id, emp_id)""")
def _(c):
    notes = similarity.score_all(
        R.as_vectors(c.queries, "query_id", "qvec"), R.as_vectors(R.document_vectors(c.sections), "doc_id", "vec")
    ).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("doc_id"), "sim")
    best = notes.join(c.authors.select("doc_id", "emp_id"), "doc_id").groupBy("query_id", "emp_id").agg(
        F.max("sim").alias("best_note")
    )
    return R.profile_position(profile_sims(c)).join(best, ["query_id", "emp_id"])
