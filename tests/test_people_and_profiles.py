import json
import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from knowhow.operators import evaluation as E, grounding as G, people as N, profiles as P, ranking as R, themes as H
from knowhow.streaming import registration as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(
        [(1, "project", None, "done", "2024-01-01"), (2, "idea", None, None, "2020-01-01"), (3, "proposal", "accepted", None, None)],
        "doc_id long, doc_type string, result string, pj_status string, d string",
    ).select("doc_id", "doc_type", "result", "pj_status", F.when(F.col("doc_type") != "project", F.to_date("d")).alias("submitted_at"),
             F.when(F.col("doc_type") == "project", F.to_date("d")).alias("started_at"))
    authors = spark.createDataFrame(
        [(1, 100, "lead"), (1, 101, "member"), (2, 101, "poster"), (3, 102, "proposer"), (2, 103, "poster"), (3, 999, "proposer"), (1, 104, "guest")],
        "doc_id long, emp_id long, role string")
    emps = spark.createDataFrame([(100, 1, True), (101, 1, True), (102, 2, True), (103, 2, False), (104, 2, True)], "emp_id long, dept_id long, is_active boolean")
    scores = spark.createDataFrame([(7, 1, 0.8, 11), (7, 2, 0.5, 21), (7, 3, 0.4, 31)], "query_id long, doc_id long, score double, section_id long")
    return docs, authors, emps, scores


def test_people_scores(spark, corpus):
    docs, authors, emps, scores = corpus
    c = R.contributions(scores, docs, authors, emps)
    got = {r["emp_id"]: (round(r["score"], 9), r["proven"]) for r in R.person_scores(c).collect()}
    # inactive and unknown people are dropped, an unknown role weighs nothing
    assert got == {100: (0.8, True), 101: (round(0.5 + 0.3 * 0.48, 9), False), 102: (0.4, True), 104: (0.0, True)}
    fresh = {(r["emp_id"], r["doc_id"]): round(r["contribution"], 9) for r in R.contributions(scores, docs, authors, emps, recency=0.1).collect()}
    assert fresh[(100, 1)] == round(0.8 * 0.8, 9) and fresh[(101, 2)] == 0.25 and fresh[(102, 3)] == 0.4
    q = spark.createDataFrame([(7, 100)], "query_id long, searcher long")
    some = R.contributions(scores, docs, authors, emps, q, years=[2024, 2020], depts=[1])
    assert {r["emp_id"] for r in some.collect()} == {101}


def test_blend_properties(spark, corpus):
    docs, authors, emps, scores = corpus
    p = R.person_scores(R.contributions(scores, docs, authors, emps))
    sims = spark.createDataFrame([(7, e, s) for e, s in ((100, 0.2), (101, 0.9), (102, 0.3), (103, 0.95), (104, 0.25))], "query_id long, emp_id long, sim double")
    same = R.blend_profiles(p, sims, emps, 1.0)
    assert rows(same, "emp_id", "score") == rows(p, "emp_id", "score")
    scaled = {r["emp_id"]: r["scaled"] for r in R.scale_similarity(sims).collect()}
    assert scaled[102] == 0.0 and scaled[103] == 1.0 and scaled[101] == pytest.approx(0.6 / 0.65)
    b = {r["emp_id"]: r for r in R.blend_profiles(p, sims, emps, 0.5).collect()}
    assert set(b) == {100, 101, 102, 104} and all(0 <= r["score"] <= 1 for r in b.values())
    assert b[100]["score"] == pytest.approx(0.5) and b[101]["score"] > b[100]["score"]


def test_rrf_ignores_order_and_weightless_rankings(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, section_id long, rank int")
    b = spark.createDataFrame([(1, 6, 1)], "query_id long, section_id long, rank int")
    x = rows(R.rrf([(a, 1.0), (b, 0.5)]), "section_id", "score")
    assert [(i, round(s, 12)) for i, s in x] == [(i, round(s, 12)) for i, s in rows(R.rrf([(b, 0.5), (a, 1.0), (b, 0.0)]), "section_id", "score")]
    assert x[1][1] == pytest.approx(1 / 62 + 0.5 / 61)


def test_gates_and_decomposition(spark, corpus):
    docs, authors, emps, _ = corpus
    vec = spark.createDataFrame([(7, 11, 0.5, 1), (7, 21, 0.4999, 2), (8, 21, 0.9, 1)], "query_id long, section_id long, score double, rank int")
    fts = spark.createDataFrame([(7, 21, 8.0, 1), (7, 31, 7.9, 2)], "query_id long, section_id long, score double, rank int")
    h = R.gated_hybrid(vec, fts)
    got = {(r["query_id"], r["section_id"]): round(r["score"], 12) for r in h.collect()}
    assert got == {(7, 11): round(0.5 / 61, 12), (7, 21): round(0.5 / 61, 12), (8, 21): round(1 / 61, 12)}
    only_text = R.gated_hybrid(vec, fts, w_fts=1.0)
    assert {(r["section_id"], r["score"]) for r in only_text.where("query_id = 7").collect()} == {(11, 0.0), (21, 1 / 61)}
    sec = spark.createDataFrame([(11, 1), (21, 2), (31, 3)], "section_id long, doc_id long")
    c = R.contributions(R.doc_scores(h.select("query_id", "section_id", "score"), sec), docs, authors, emps)
    parts = {(r["query_id"], r["emp_id"]): r for r in R.person_parts(R.decompose(c, h)).collect()}
    for r in R.person_scores(c).collect():
        p = parts[(r["query_id"], r["emp_id"])]
        assert p["vector_part"] + p["text_part"] == pytest.approx(r["score"], abs=1e-5)
    assert parts[(7, 101)]["confidence"] == "words" and parts[(7, 100)]["confidence"] == "meaning"


def test_similar_people(spark):
    v = [[1.0, 0.0], [0.95, 0.3122], [0.8, 0.6], [0.6, 0.8], [1.0, 0.0]]
    prof = spark.createDataFrame([(i + 1, x) for i, x in enumerate(v)], "emp_id long, vec array<double>")
    emps = spark.createDataFrame([(1, 10, True), (2, 10, True), (3, 20, True), (4, 20, True), (5, 30, False), (6, 30, True)], "emp_id long, dept_id long, is_active boolean")
    auth = spark.createDataFrame([(1, 1), (2, 1), (2, 3), (3, 3)], "doc_id long, emp_id long")
    egos = spark.createDataFrame([(1,), (6,)], "emp_id long")
    people, status = N.similar_people(egos, prof, emps, auth)
    assert [(r["other_id"], r["shared"], r["overlap"]) for r in people.orderBy("position").collect()] == [(3, 1, 1 / 3), (4, 0, 0.0)]
    assert rows(status, "emp_id", "candidates", "passed", "status") == [(1, 3, 2, "ok"), (6, 0, 0, "no_profile")]


def test_neighbours_and_levels(spark):
    depts = spark.createDataFrame([(1, "s1 fA課", "plant"), (2, "s1 fB課", "plant"), (3, "fA部", "hq"), (4, "fC部", "hq")], "dept_id long, dept_name string, dept_type string")
    emps = spark.createDataFrame([(i, d, True) for i, d in ((1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 1))], "emp_id long, dept_id long, is_active boolean")
    auth = spark.createDataFrame([(10, 1), (10, 6), (11, 2), (12, 3), (13, 4), (14, 5)], "doc_id long, emp_id long")
    kw = spark.createDataFrame([(10, "a", 2), (11, "a", 1), (12, "b", 1), (13, "c", 1), (14, "a", 1)], "doc_id long, term string, n long")
    prof = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, [0.9, 0.1])], "emp_id long, vec array<double>")
    n = spark.createDataFrame([(5,)], "n_docs long")
    t = N.person_terms(kw, auth, n)
    assert {round(r["s"], 9) for r in t.groupBy("emp_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()} == {1.0}
    egos = spark.createDataFrame([(1,)], "emp_id long")
    close = N.term_closeness(egos, t)
    m = N.pair_measures(egos, emps, prof, close, close, emps, depts, auth)
    assert rows(m, "other_id", "level") == [(2, 1), (3, 2), (4, 3), (5, 5), (6, 0)]
    got = {r["other_id"]: r for r in N.neighbors(m, t=0.0).collect()}
    assert got[6]["part_known"] == pytest.approx(0.3) and got[2]["part_known"] == pytest.approx(0.24) and got[4]["part_known"] == 0
    assert got[3]["prof_rel"] == 1.0 and not got[3]["surprise"]
    assert {r["other_id"] for r in N.neighbors(m, known_range=1).where("surprise").collect()} == {3}
    short = N.term_closeness(egos, t).collect()
    want = sorted((r["other_id"], round(r["sim"], 9)) for r in short)
    by_docs = N.text_closeness(egos, N.document_weights(kw, n), auth)
    for got in (N.term_closeness(egos, t, small=0), by_docs, N.text_closeness(egos, N.document_weights(kw, n), auth, small=0)):
        assert sorted((r["other_id"], round(r["sim"], 9)) for r in got.collect()) == want


def test_uniqueness_and_successors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.7, 0.7])], "doc_id long, vec array<double>")
    auth = spark.createDataFrame([(1, 100, 1), (2, 100, 1), (3, 101, 2)], "doc_id long, emp_id long, dept_id_at_time long")
    near = {r["doc_id"]: r["nearest"] for r in H.nearness(v, auth).collect()}
    assert near[4] == 1.0 and near[1] == pytest.approx(0.707107)  # a document without authors matches itself
    u = {r["doc_id"]: (r["pct"], r["is_unique"]) for r in H.uniqueness(H.nearness(v, auth), 0.25).collect()}
    assert sorted(p for p, _ in u.values()) == [0.0, 0.25, 0.5, 0.75] and sum(x for _, x in u.values()) == 1
    emps = spark.createDataFrame([(100, 1, True), (101, 1, True)], "emp_id long, dept_id long, is_active boolean")
    s = H.successors(v, auth, emps).collect()
    assert {(r["emp_id"], r["other_id"], r["doc"], r["mine"]) for r in s} == {(100, 101, 3, 2), (101, 100, 2, 3)}
    assert rows(H.person_state(emps, auth), "emp_id", "moved") == [(100, False), (101, True)]


def test_profile_text_drops_the_oldest(spark):
    notes = spark.createDataFrame(
        [(1, d, "execution", "p", f"2024-0{d}-01", "lead", "T", "x" * 40, "") for d in range(1, 6)] + [(2, 9, "ambition", "p", "2024-01-01", "lead", "T", "y" * 500, "a b")],
        "emp_id long, doc_id long, kind string, label string, note_date string, role string, title string, body string, tags string")
    one_note = len("[execution|p|lead|2024-01-01]T\n") + 40
    got = {r["emp_id"]: r for r in P.assemble(notes, 3 * one_note + 4).collect()}
    assert got[1]["used"] == 3 and len(got[1]["profile_text"]) == 3 * one_note + 4 and got[1]["profile_text"].index("2024-03") < got[1]["profile_text"].index("2024-05")
    assert got[2]["used"] == 0 and got[2]["profile_text"] == "" and got[2]["notes"] == 1
    assert {r["emp_id"]: r["used"] for r in P.assemble(notes, 3 * one_note + 3).collect()}[1] == 2
    built = P.assemble(notes)
    stored = built.select("emp_id", "profile_text", F.lit("2026-01-01").alias("embedded_at"))
    assert P.to_rebuild(built, stored).count() == 0  # a second run changes nothing
    assert rows(P.to_rebuild(built, stored.where("emp_id = 1").withColumn("embedded_at", F.lit(None).cast("string"))), "emp_id", "is_new") == [(1, False), (2, True)]


def test_claims(spark):
    mat = spark.createDataFrame(
        [(1, "PJ-2024-0001", 1, "project", "done", "cut 30% in 2024"), (1, "PJ-2024-0002", 2, "project", "cancelled", "stop"), (1, "career:effort", None, None, None, "learn")],
        "emp_id long, source string, doc_id long, doc_type string, status string, text string")
    claims = spark.createDataFrame(
        [(1, 1, "strength", 1, "good", None, ["PJ-2024-0001", "fake"]), (2, 1, "strength", 2, "career only", None, ["career:effort"]),
         (3, 1, "track_record", 1, "cut 30%", None, ["PJ-2024-0001"]), (4, 1, "track_record", 2, "stopped", None, ["PJ-2024-0002"]),
         (5, 1, "ambition", 1, "cut 99", None, ["career:effort"]), (6, 1, "caveat", 1, " この人は、careful", None, ["fake"]), (7, 1, "relation", 1, "", "none", []),
         (8, 1, "relation", 2, "この人がnear この人は", "partial", ["PJ-2024-0002", "fake", "fake"]), (9, 1, "ambition", 2, " ", None, ["career:effort"])]
        + [(10 + i, 1, "ambition", 3 + i, f"w{'i' * i}", None, ["career:effort", "career:effort"]) for i in range(5)],
        "claim_id long, emp_id long, section string, seq int, text string, level string, sources array<string>")
    got = {r["claim_id"]: r for r in G.verify_claims(claims, mat).collect()}
    assert {k for k, r in got.items() if r["reason"] is None} == {1, 3, 6, 7, 8, 10, 11, 12, 13, 14}
    assert got[2]["reason"] == "no document source" and got[4]["reason"] == "no source" and got[5]["reason"] == "number not in material"
    assert got[1]["sources"] == ["PJ-2024-0001"] and got[10]["sources"] == ["career:effort"]
    assert got[7]["shown"] == G.NO_MATCH and got[8]["shown"] == G.NOT_DIRECT + "near この人は" and got[6]["shown"] == "careful"
    assert [got[k]["bad_sources"] for k in (1, 2, 4, 5, 6, 7, 8)] == [["fake"], [], ["PJ-2024-0002"], [], ["fake"], [], ["fake", "fake"]]
    assert [got[k]["position"] for k in (10, 11, 12, 13)] == [1, 2, 3, None]
    assert all(r["section"] != "relation" for r in G.verify_claims(claims, mat, has_query=False).collect())
    msg = spark.createDataFrame([(1, "PJ-2024-0001を見た。KZ-1999-0001も。終わり")], "message_id long, text string")
    ok = spark.createDataFrame([(1, "PJ-2024-0001")], "message_id long, code string")
    r = G.drop_unknown_codes(msg, ok).first()
    assert (r["kept_text"], r["n_dropped"], r["dropped"]) == ("PJ-2024-0001を見た。終わり", 1, "KZ-1999-0001も。")


def test_numbers_in_full_texts_are_material(spark):
    mat = spark.createDataFrame([(1, "A", 1, "project", "done", "cut"), (2, "B", 2, "project", "done", "cut")],
                                "emp_id long, source string, doc_id long, doc_type string, status string, text string")
    claims = spark.createDataFrame([(i, e, "ambition", i, f"cut {n}", None, [s]) for i, (e, n, s) in enumerate([(1, 7, "A"), (1, 8, "A"), (2, 8, "B"), (2, 7, "B")])],
                                   "claim_id long, emp_id long, section string, seq int, text string, level string, sources array<string>")
    texts = spark.createDataFrame([(1, "a ７ b"), (1, None), (2, "9"), (2, "8"), (3, "7 8")], "doc_id long, text string")
    got = rows(G.verify_claims(claims, mat, full_texts=texts), "claim_id", "reason")
    assert got == [(0, None), (1, "number not in material"), (2, None), (3, "number not in material")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_claims_of_the_corpus_are_held_against_bodies_and_texts(spark):
    from knowhow.plans import profiles as plans
    from knowhow.sources.corpus import Corpus

    c = Corpus(spark, "/root/testdata/sf0.001")

    def numbers(text):
        return set(re.findall(r"[0-9]+(?:\.[0-9]+)?", unicodedata.normalize("NFKC", text or "")))

    docs, have = {}, {}
    for x in c.table("documents").collect():
        docs.setdefault(x.doc_id // 4, set()).update(numbers(x.text))
    for x in c.authors.collect():
        have.setdefault(x.emp_id, set()).update(docs.get(x.doc_id, ()))
    for x in plans.notes(c).collect():
        have.setdefault(x.emp_id, set()).update(numbers(x.body) | numbers(x.title) | numbers(x.note_date))
    stated = {x.claim_id: (x.emp_id, numbers(x.text)) for x in plans.claims(c).collect()}
    dropped = [x.claim_id for x in plans.verified(c).where("reason = 'number not in material'").collect()]
    assert dropped and all(stated[k][1] - have.get(stated[k][0], set()) for k in dropped)


def test_every_ego_has_a_status(spark):
    egos = spark.createDataFrame([(1,), (2,), (3,), (1,)], "emp_id long")
    people = spark.createDataFrame([(1,), (3,), (4,)], "emp_id long")
    near = spark.createDataFrame([(1, 4, 0.5), (1, 3, 0.4)], "emp_id long, other_id long, score double")
    got = N.with_status(egos, people, near).collect()
    assert {tuple(r) for r in got} == {(1, 4, 0.5, "ok"), (1, 3, 0.4, "ok"), (2, None, None, "no_docs"), (3, None, None, "ok")} and len(got) == 4


def test_query_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    people = spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.8), (1, 7, 0.7)], "query_id long, emp_id long, score double")
    docs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8)], "query_id long, doc_id long, score double")
    gp = spark.createDataFrame([(1, 6), (1, 9)], "query_id long, emp_id long")
    gd = spark.createDataFrame([(1, 1, True), (1, 8, True), (1, 2, False)], "query_id long, doc_id long, expected boolean")
    m = {r["query_id"]: r for r in E.query_metrics(q, people, docs, gp, gd).collect()}
    assert (m[1]["first"], m[1]["rr"], m[1]["rec_people"], m[1]["rec_docs"], m[1]["negatives"]) == (2, 0.5, 0.5, 0.5, 1)
    assert m[2]["rr"] == 0.0 and m[2]["rec_people"] is None


def test_stream_of_registrations(spark, tmp_path):
    state, arrivals = str(tmp_path / "state"), tmp_path / "in"
    arrivals.mkdir()
    docs = "doc_id long, doc_code string, doc_type string, title string, result string, pj_status string, submitted_at date, started_at date, ended_at string, decided_at string"
    empty = {
        "documents": docs, "sections": "section_id long, doc_id long, section_no int, section_name string, section_role string, body string, embedding array<float>",
        "authors": "doc_id long, emp_id long, role string, dept_id_at_time long", "keywords": "doc_id long, keyword string, count long"}
    S.save_state({t: spark.createDataFrame([], s) for t, s in empty.items()}, state, 0)

    def arrive(name, *items):
        (arrivals / name).write_text("\n".join(json.dumps(i) for i in items))

    def doc(i, code, body, **extra):
        return {"doc_id": i, "doc_code": code, "doc_type": "idea", "title": f"Title {code}", "submitted_at": "2026-01-01",
                "sections": [{"section_no": 1, "section_name": "issue", "section_role": "problem", "body": body}],
                "authors": [{"emp_id": 100 + i, "role": "poster", "dept_id_at_time": 1}], **extra}

    built = []
    arrive("a.json", doc(1, "IDEA-2026-0001", "valve leak valve"), doc(2, "bad code", "text"))
    S.start(spark, str(arrivals), state, str(tmp_path / "cp"), lambda p: built.append(sorted(r["emp_id"] for r in p.collect()))).awaitTermination()
    one = S.load_state(spark, state, 1)
    assert rows(one["documents"], "doc_id") == [(1,)] and built == [[101]]
    first_id = one["sections"].first()["section_id"]
    arrive("b.json", doc(1, "IDEA-2026-0001", "pump noise"))
    S.start(spark, str(arrivals), state, str(tmp_path / "cp")).awaitTermination()
    two = S.load_state(spark, state, 2)
    assert [(r["section_id"], r["body"]) for r in two["sections"].collect()] == [(first_id, "pump noise")]
    assert "valve" not in {r["keyword"] for r in two["keywords"].collect()}
    # The code says which document it is: a known code under another id, a new code under a known id, and one without an id.
    arrive("c.json", doc(77, "IDEA-2026-0001", "third text"), doc(1, "IDEA-2026-0002", "other document"), doc(0, "IDEA-2026-0003", "no id", doc_id=None),
           doc(9, "IDEA-2026-0004", "x", sections=[]))
    S.start(spark, str(arrivals), state, str(tmp_path / "cp"), model=lambda texts: [[float(len(t))] for t in texts]).awaitTermination()
    three = S.load_state(spark, state, 3)
    ids = {r["doc_code"]: r["doc_id"] for r in three["documents"].collect()}
    assert ids["IDEA-2026-0001"] == 1 and min(ids["IDEA-2026-0002"], ids["IDEA-2026-0003"]) >= 1 << 62 and len(ids) == 3
    bodies = {r["doc_id"]: (r["body"], r["embedding"]) for r in three["sections"].collect()}
    assert bodies[1][0] == "third text" and set(bodies) == set(ids.values()) and all(v and v[0] > 0 for _, v in bodies.values())
    refused = {(r["doc_code"], r["rule"]) for v in (1, 3) for r in spark.read.parquet(f"{state}/v{v}/refused").collect()}
    assert refused == {("bad code", "code form"), ("IDEA-2026-0004", "no section")}
    # Between whole versions a version holds only its own batch; the same arrivals again give the same tables.
    assert spark.read.parquet(f"{state}/v3/documents").count() == 3
    arrive("d.json", doc(5, "IDEA-2026-0002", "other document"))
    S.start(spark, str(arrivals), state, str(tmp_path / "cp"), model=lambda texts: [[float(len(t))] for t in texts]).awaitTermination()
    four = S.load_state(spark, state, 4)
    same = ("documents", "sections", "keywords")
    assert all(sorted(map(str, three[t].collect())) == sorted(map(str, four[t].collect())) for t in same)
    assert spark.read.parquet(f"{state}/v4/documents").count() == 1


def test_whole_tables_are_written_every_so_many_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "WHOLE_EVERY", 2)
    state = str(tmp_path)
    empty = {
        "documents": "doc_id long, doc_code string, doc_type string, title string", "authors": "doc_id long, emp_id long", "keywords": "doc_id long, keyword string, count long",
        "sections": "section_id long, doc_id long, section_no int, body string, embedding array<float>"}
    S.save_state({t: spark.createDataFrame([], s) for t, s in empty.items()}, state, 0)
    for v in range(3):
        batch = spark.createDataFrame(
            [(i, f"IDEA-2026-000{i}", "idea", f"t{v}", *[None] * 6, [(1, "issue", "problem", f"body {v}")], [(7, "poster", 1)]) for i in (v, v + 1)], S.ARRIVAL)
        S.register_batch(spark, batch, state, v)
        got = {r["doc_id"]: r["title"] for r in S.load_state(spark, state, v + 1)["documents"].collect()}
        assert got == {i: f"t{min(i, v)}" for i in range(v + 2)}
        assert spark.read.parquet(f"{state}/v{v + 1}/documents").count() == (v + 2 if (v + 1) % 2 == 0 else 2)
