import contextlib
import io
import itertools
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knowhow.operators import clusters as C, fulltext, inverted, similarity as S


def frame(spark, vecs, groups=None):
    rows = [(i, [float(x) for x in v]) + ((groups[i],) if groups else ()) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "id long, vec array<double>" + (", grp array<long>" if groups else ""))


@pytest.fixture(scope="module")
def vecs():
    v = np.random.default_rng(3).normal(size=(120, 8))
    v[40:80] = v[0]  # a third of the rows are copies
    return v


def cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


def best(sim, k, allowed):
    out = {}
    for i in range(len(sim)):
        cand = sorted((-sim[i, j], j) for j in range(len(sim)) if allowed(i, j))
        out[i] = [(j, -s) for s, j in cand[:k]]
    return out


@pytest.mark.parametrize("block_rows", [17, 1000])
def test_self_top_k_matches_brute_force(spark, vecs, block_rows):
    want = best(cosines(vecs), 5, lambda i, j: i != j)
    rows = S.self_top_k(frame(spark, vecs), 5, block_rows=block_rows).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["left_id"], []).append((r["right_id"], r["sim"]))
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}


def test_groups_never_match(spark, vecs):
    groups = [[i % 7, 100 + i // 30] if i % 11 else [] for i in range(len(vecs))]
    want = best(cosines(vecs), 3, lambda i, j: not set(groups[i]) & set(groups[j]))
    rows = S.self_top_k(frame(spark, vecs, groups), 3, drop_self=False, block_rows=25).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["left_id"], []).append(r["right_id"])
    assert got == {i: [j for j, _ in v] for i, v in want.items() if v}
    assert got[0][0] == 0  # a row without groups may match itself


def test_pairs_and_percentiles(spark, vecs):
    sim = cosines(vecs)
    iu = np.triu_indices(len(vecs), 1)
    got = {(r["left_id"], r["right_id"]): r["sim"] for r in S.pairs_above(frame(spark, vecs), 0.6, block_rows=31).collect()}
    want = {(i, j): sim[i, j] for i, j in zip(*iu) if sim[i, j] >= 0.6}
    assert got.keys() == want.keys()
    ps = {r["pct"]: r["sim"] for r in S.pair_percentiles(frame(spark, vecs), block_rows=31).collect()}
    for p, v in ps.items():
        assert v == pytest.approx(np.percentile(sim[iu], p), abs=2e-6)


def test_left_right_and_zero_vector(spark, vecs):
    left = frame(spark, [np.zeros(8), vecs[5]])
    rows = S.top_k(left, frame(spark, vecs), 2, block_rows=40).orderBy("left_id", "rank").collect()
    assert [r["sim"] for r in rows if r["left_id"] == 0] == [0.0, 0.0]
    assert [r["right_id"] for r in rows if r["left_id"] == 1][0] == 5


def test_approximate_search_on_64_dimensions(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(150, 64))
    v = centres[rng.integers(0, 150, 3000)] + 0.6 * rng.normal(size=(3000, 64))
    q, df = frame(spark, v[:150] + 0.1 * rng.normal(size=(150, 64))), frame(spark, v)
    index = S.build_index(df, 64, path=str(tmp_path / "index"))
    pairs = S.candidate_pairs(q, index).count()
    assert pairs < 0.05 * 150 * 3000
    exact = {(r.left_id, r.right_id): r.sim for r in S.top_k(q, df, 10).collect()}
    near = {(r.left_id, r.right_id): r.sim for r in S.approximate_top_k(q, df, 10, index).collect()}
    found = exact.keys() & near.keys()
    assert len(near) == 1500 and len(found) >= 0.9 * len(exact) and all(abs(exact[p] - near[p]) <= 1e-6 for p in found)
    assert index.rows.count() == 32 * 3000


@pytest.mark.parametrize("copies, k", [(3, 10), (40, 10), (40, 50)])
def test_equal_vectors_are_indexed_once(spark, copies, k):
    rng = np.random.default_rng(5)
    v = np.vstack([rng.normal(size=(20, 64))] * copies)[rng.permutation(20 * copies)]
    q, df = frame(spark, v[:7]), frame(spark, np.vstack([v, rng.normal(size=(5, 64))]))
    index = S.build_index(df, 64)
    assert index.rows.count() == 32 * 25 and index.copies.count() == 20 * copies
    got, want = (sorted((r.left_id, r["rank"], r.right_id) for r in x.where("sim > 0.99").collect()) for x in (S.approximate_top_k(q, df, k, index), S.top_k(q, df, k)))
    assert got == want and len(got) == 7 * min(copies, k)


def test_queries_without_enough_candidates_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 64))
    q, df = frame(spark, np.vstack([rng.normal(size=(4, 64)), np.zeros((1, 64))])), frame(spark, v)
    index = S.build_index(df, 64, tables=1)
    got = sorted((r.left_id, r["rank"], r.right_id) for r in S.approximate_top_k(q, df, 40, index, probes=1).collect())
    want = sorted((r.left_id, r["rank"], r.right_id) for r in S.top_k(q, df, 40).collect())
    assert got == want


def test_short_and_long_left_sides_give_the_same(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(500, 8)), 1)
    v[100:200] = v[:100]
    df = frame(spark, v).repartition(7)
    for drop in (False, True):
        short, long = (sorted(map(tuple, S.top_k(df, df, 9, drop_self=drop, block_rows=n).collect())) for n in (500, 64))
        assert short == long and len(short) == 4500
        short, long = (sorted(map(tuple, S.score_all(df, df, drop_self=drop, block_rows=n).collect())) for n in (500, 200))
        assert short == long
    small = S.top_k(df.where("id < 3"), df, 9, block_rows=16)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, S.top_k(df, df, 9).where("left_id < 3").collect()))
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    assert S.top_k(df.where("id < 0"), df, 9).count() == 0 and S.top_k(df, df.where("id < 0"), 9).count() == 0


def test_bm25_equals_the_formula(spark):
    texts = [(1, "ab cd"), (2, "abab"), (3, ""), (4, None), (5, "xyz 漢字 漢字"), (6, "a"), (7, "ab cd"), (8, "😀ab😀ab")]
    queries = [(1, "ab"), (2, "漢字 xy"), (3, None), (4, "q"), (5, "abcd 😀a")]
    grams = {i: [t[j : j + 2] for j in range(len(t) - 1)] for i, t in ((i, "".join((t or "").split())) for i, t in texts)}
    mean = sum(map(len, grams.values())) / len(texts)
    want = {}
    for q, t in queries:
        t = "".join((t or "").split())
        for g in {t[j : j + 2] for j in range(len(t) - 1)}:
            df = sum(g in x for x in grams.values())
            for i, x in grams.items():
                if g in x:
                    n = x.count(g)
                    want[q, i] = want.get((q, i), 0) + np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(x) / mean))
    items = spark.createDataFrame(texts, "section_id long, body string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    for block in (2_000_000, 1):
        got = {(r.query_id, r.section_id): r.score for r in fulltext.bm25(items, asked, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    top = {(r.query_id, r["rank"]): r.section_id for r in fulltext.bm25(items, asked, k=2).collect()}
    for q in (1, 2, 5):
        order = sorted((-round(s, 6), i) for (p, i), s in want.items() if p == q)
        assert [top[q, n + 1] for n in range(min(2, len(order)))] == [i for _, i in order[:2]]
    assert fulltext.bm25(items.where("section_id < 0"), asked).count() == 0 and fulltext.bm25(items, asked.where("query_id < 0"), k=3).count() == 0


def test_text_index_after_changes(spark, tmp_path):
    rows = [(i, i // 4, f"alpha beta word{i % 7} word{i % 3} AB-12") for i in range(60)] + [(60, 15, None), (61, 15, "")]
    sections = spark.createDataFrame(rows, "section_id long, doc_id long, body string")
    inverted.by_part(inverted.postings(sections).write).parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    changed = spark.createDataFrame([(5, 1, "gamma gamma"), (70, 17, "alpha new")], "section_id long, doc_id long, body string")
    removed = spark.createDataFrame([(6,)], "section_id long")
    after = inverted.with_changes(index, changed, removed)
    keep = sections.where("section_id not in (5, 6)").unionByName(changed)
    cols = ["term", "section_id", "doc_id", "n"]
    assert sorted(map(tuple, after.select(*cols).collect())) == sorted(map(tuple, inverted.postings(keep).select(*cols).collect()))
    q = spark.createDataFrame([(1, "gamma"), (1, "new"), (2, "nowhere"), (3, "ab-12")], "query_id long, term string")
    got = {(r.query_id, r.section_id): r.score for r in inverted.search(after, q).collect()}
    assert got == {(1, 5): 2.0, (1, 70): 1.0} | {(3, i): 1.0 for i in range(60) if i not in (5, 6)}
    stats = {r.term: (r.df, r.total, r.most) for r in inverted.term_statistics(after).collect()}
    assert stats["gamma"] == (1, 2, 2) and stats["alpha"] == (59, 59, 1)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        inverted.look_up(index, q).explain("formatted")
    assert re.search(r"PartitionFilters: \[[^\n]*part#\d+ (IN|=|INSET)", out.getvalue())
    assert len({r.part for r in index.select("part").distinct().collect()}) > 3


def test_counts_of_two_blocks_need_no_copies_of_their_product():
    rng = np.random.default_rng(35)

    def block(first, n):
        vecs = pa.array(rng.normal(size=(n, 8)).tolist(), pa.list_(pa.float64()))
        groups = pa.array([[int(g)] for g in rng.integers(0, 40, n)], pa.list_(pa.int64()))
        return pa.table({"id": np.arange(first, first + n), "vec": vecs, "grp": groups})

    left, right = block(0, 4096), block(5000, 2048)
    run = S._kernel("bins", None, None, 6, True, False, S._arrow_schema("bins"))
    tracemalloc.start()
    found = run((0, 1), left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    units = [np.array(t.column("vec").to_pylist()) for t in (left, right)]
    units = [u / np.linalg.norm(u, axis=1, keepdims=True) for u in units]
    groups = [np.array(t.column("grp").to_pylist())[:, 0] for t in (left, right)]
    sim = (units[0] @ units[1].T)[groups[0][:, None] != groups[1][None, :]]
    values, n = np.unique(np.rint(np.round(sim, 6) * 10**6).astype(np.int64), return_counts=True)
    assert found.column("bin").to_pylist() == values.tolist() and found.column("n").to_pylist() == n.tolist()
    assert peak < 3 * 8 * 4096 * 2048
    twice = S._sum_of(pa.concat_tables([found, found]))
    assert twice.column("bin").to_pylist() == values.tolist() and twice.column("n").to_pylist() == (2 * n).tolist()


def components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for e in edges for x in e}


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(60)] + [(200, int(x)) for x in range(201, 260)]
    edges += [(int(a) + 300, int(b) + 300) for a, b in rng.integers(0, 80, size=(50, 2)) if a != b]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in C.connected_components(df).collect()}
    assert got == components(400, edges)


def linkage(sim, th, method):
    """One merge at a time, highest link first, lowest pair on ties."""
    groups = {i: [i] for i in range(len(sim))}
    while True:
        best_pair = None
        for a in groups:
            for b in groups:
                if a < b:
                    block = sim[np.ix_(groups[a], groups[b])]
                    link = round(float(block.mean() if method == "average" else block.min()), 9)
                    if link >= th and (best_pair is None or (-link, a, b) < best_pair):
                        best_pair = (-link, a, b)
        if best_pair is None:
            return {i: g for g, m in groups.items() for i in m}
        _, a, b = best_pair
        groups[a] += groups.pop(b)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_linkages_match_one_merge_at_a_time(spark, block_rows):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, 6))
    v = np.concatenate([c + 0.45 * rng.normal(size=(8, 6)) for c in centres])
    docs = np.repeat(np.arange(20), 2)  # two sections per document
    sim = cosines(v)
    doc_sim = np.array([[sim[np.ix_(docs == a, docs == b)].max() for b in range(20)] for a in range(20)])
    rows = [(i, int(docs[i]), [float(x) for x in v[i]]) for i in range(len(v))]
    s = spark.createDataFrame(rows, "section_id long, doc_id long, embedding array<double>")
    got = {r["doc_id"]: r["cluster"] for r in C.average_linkage(s, 0.55, block_rows=block_rows).collect()}
    assert got == linkage(doc_sim, 0.55, "average")
    full = C.complete_linkage(C.document_pairs(s, 0.55), s.select("doc_id").distinct(), 0.55)
    assert {r["doc_id"]: r["cluster"] for r in full.collect()} == linkage(doc_sim, 0.55, "complete")


@pytest.mark.parametrize("at_once", [0, 50])
def test_average_linkage_forms_the_means_of_merged_clusters_only(spark, monkeypatch, at_once):
    rng = np.random.default_rng(31)
    docs = np.r_[np.repeat(np.arange(9), 2), np.full(11, 9), 20, 21, 22]  # one document is larger than a block
    v = np.repeat(rng.normal(size=(3, 6)), 8, axis=0)
    v = np.r_[v, v[:5], -10 * np.eye(6)[:3]] + 0.5 * rng.normal(size=(32, 6))
    sim, ids = cosines(v), np.unique(docs)
    doc_sim = np.array([[sim[np.ix_(docs == a, docs == b)].max() for b in ids] for a in ids])
    rows = [(i, int(docs[i]), [float(x) for x in v[i]]) for i in range(len(v))]
    s = spark.createDataFrame(rows, "section_id long, doc_id long, embedding array<double>")
    met, sums = [], C._cluster_sums
    monkeypatch.setattr(C, "_cluster_sums", lambda r, *a: met.append(r.select("doc_id").distinct().count()) or sums(r, *a))
    got = {r["doc_id"]: r["cluster"] for r in C.average_linkage(s, 0.5, block_rows=7, at_once=at_once).collect()}
    assert got == {int(ids[a]): int(ids[b]) for a, b in linkage(doc_sim, 0.5, "average").items()}
    assert 1 < len(set(got.values())) < len(got)
    assert met[-1] < len(ids) if at_once == 0 else len(met) == 1


def test_complete_linkage_keeps_links_of_complete_pairs_only(spark, monkeypatch):
    rng = np.random.default_rng(33)
    sim = np.round(rng.uniform(0.3, 1.0, size=(14, 14)), 6)
    sim = np.maximum(sim, sim.T)
    pairs = spark.createDataFrame([(a, b, float(sim[a, b])) for a in range(14) for b in range(a + 1, 14)], "a long, b long, sim double")
    kept, complete = [], C._complete_links
    monkeypatch.setattr(C, "_complete_links", lambda links, moves: kept.append(links.count()) or complete(links, moves))
    docs = spark.createDataFrame([(i,) for i in range(14)], "doc_id long")
    got = {r.doc_id: r.cluster for r in C.complete_linkage(pairs, docs, 0.5).collect()}
    assert got == linkage(sim, 0.5, "complete")
    assert all(b < a for a, b in zip(kept, kept[1:])) and kept[-1] < kept[0] / 10


def test_linkage_of_sections_matches_one_merge_at_a_time(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 8))
    v = np.concatenate([c + 0.4 * rng.normal(size=(9, 8)) for c in centres])
    docs = np.r_[np.repeat(np.arange(18), 2), np.full(9, 3), np.arange(9) + 40]  # one document holds a whole group
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    sim[docs[:, None] == docs[None, :]] = 0.0
    rows = [(i, int(docs[i]), [float(x) for x in v[i]]) for i in range(len(v))]
    s = spark.createDataFrame(rows, "section_id long, doc_id long, embedding array<double>")
    for th in (0.5,):
        got = {r.section_id: r.cluster for r in C.average_linkage_of_sections(s, th).collect()}
        assert got == linkage(sim, th, "average") and 1 < len(set(got.values())) < len(v)
    assert {r.doc_id for r in C.average_linkage_of_sections(s, 0.7).where("section_id = 40").collect()} == {3}


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_percentiles_of_document_pairs(spark, block_rows):
    v = np.random.default_rng(8).normal(size=(70, 6))
    v[20:40] = v[3]
    docs = np.r_[np.repeat(np.arange(25), 2), np.full(20, 30)]  # one document of many sections
    sim, ids = cosines(v), np.unique(docs)
    best = [sim[np.ix_(docs == a, docs == b)].max() for i, a in enumerate(ids) for b in ids[i + 1 :]]
    rows = [(i, int(docs[i]), [float(x) for x in v[i]]) for i in range(len(v))]
    s = spark.createDataFrame(rows, "section_id long, doc_id long, embedding array<double>")
    for r in C.pair_percentiles(s, (10.0, 50.0, 99.0), block_rows=block_rows).collect():
        assert r.sim == pytest.approx(np.percentile(best, r.pct), abs=2e-6)


def test_lowest_similarity_with_a_split_document(spark):
    rng = np.random.default_rng(21)
    docs = np.array([0] * 30 + [1] * 3 + [2] * 20 + [3, 4, 5])  # two documents larger than a block
    v = rng.normal(size=(len(docs), 5))
    sim = cosines(v)
    doc_sim = [sim[np.ix_(docs == a, docs == b)].max() for a in range(6) for b in range(a + 1, 6)]
    rows = [(i, int(docs[i]), [float(x) for x in v[i]]) for i in range(len(v))]
    s = spark.createDataFrame(rows, "section_id long, doc_id long, embedding array<double>")
    one = spark.createDataFrame([(d, 0) for d in range(6)], "doc_id long, cluster long")
    dept = spark.createDataFrame([(d, d % 2) for d in range(6)], "doc_id long, dept_id long")
    for size in (8, 1000):
        row = C.valid_clusters(one, s, dept, 4, 2, block_rows=size).first()
        assert (row["size"], row["dept_count"]) == (6, 2)
        assert row["min_sim"] == pytest.approx(min(doc_sim), abs=2e-6)


def test_document_pair_percentiles(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 6))
    docs = np.arange(60) // 3
    sim = cosines(v)
    doc_sim = [sim[np.ix_(docs == a, docs == b)].max() for a in range(20) for b in range(a + 1, 20)]
    rows = [(i, int(docs[i]), [float(x) for x in v[i]]) for i in range(60)]
    s = spark.createDataFrame(rows, "section_id long, doc_id long, embedding array<double>")
    for r in C.pair_percentiles(s, (90.0, 99.0)).collect():
        assert r["sim"] == pytest.approx(np.percentile(doc_sim, r["pct"]), abs=2e-6)


@pytest.mark.parametrize("block_rows", [64, 200])
def test_pivots_give_the_pairs_of_all_blocks(spark, block_rows):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(12, 16))[rng.integers(0, 12, 600)] + 0.15 * rng.normal(size=(600, 16))
    v[100:220] = v[0]  # copies fill more than a block
    v[300:303] = 0.0
    v[303:420] = rng.normal(size=(117, 16))
    sim = cosines(np.where(v.any(axis=1, keepdims=True), v, 1.0))
    sim[300:303, :] = 0.0
    sim[:, 300:303] = 0.0
    df = frame(spark, v).repartition(5)
    for threshold in (0.9, 0.3, 0.0, -0.2):
        got = {(r.left_id, r.right_id): r.sim for r in S.pairs_above(df, threshold, block_rows=block_rows).collect()}
        want = {(i, j): sim[i, j] for i, j in zip(*np.triu_indices(600, 1)) if sim[i, j] >= threshold}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 1e-6 for p in want)
    groups = [[i % 5] if i % 3 else [] for i in range(600)]
    for k in (1, 7):
        rows = sorted(map(tuple, S.self_top_k(frame(spark, v, groups), k, block_rows=block_rows).collect()))
        assert rows == sorted(map(tuple, S.self_top_k(frame(spark, v, groups), k, block_rows=1000).collect()))
        assert len(rows) == 600 * k


def test_pivots_leave_out_most_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    n = 3000
    v = rng.normal(size=(25, 64))[rng.integers(0, 25, n)] + 0.25 * rng.normal(size=(n, 64))
    df = frame(spark, v)
    every = n * (n - 1) / 2
    assert S._self_tiles(df, n, "pairs", threshold=0.8, block_rows=300).compared() < 0.25 * every
    assert S._self_tiles(df, n, "top", k=5, drop_self=True, block_rows=300).compared() < 0.5 * every


def test_self_joins_of_one_direction_and_of_nothing(spark):
    same = frame(spark, [[1.0, 2.0]] * 90)
    assert S.pairs_above(same, 0.999, block_rows=20).count() == 90 * 89 // 2
    assert S.self_top_k(same, 3, block_rows=20).where("sim = 1").count() == 270
    zero = frame(spark, [[0.0, 0.0]] * 50)
    assert S.pairs_above(zero, 0.0, block_rows=20).count() == 50 * 49 // 2 and S.pairs_above(zero, 0.1, block_rows=20).count() == 0
    empty = same.where("id < 0")
    assert S.pairs_above(empty, 0.5).count() == 0 and S.self_top_k(empty, 3).count() == 0


def test_links_connect_what_the_pairs_connect(spark):
    v = np.random.default_rng(5).normal(size=(300, 8))
    df = frame(spark, v)
    pairs = C.connected_components(S.pairs_above(df, 0.75, block_rows=40).select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    links = S.links_above(df, 0.75, block_rows=40).cache()
    stars = C.connected_components(links.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, stars.collect())) != []


def test_blocks_are_not_copied_per_pair(spark):
    df = frame(spark, np.random.default_rng(6).normal(size=(400, 8)))
    stored = S._self_tiles(df, 400, "pairs", threshold=0.2, block_rows=20).blocks
    assert stored.count() >= 20 and stored.select(F.count_distinct("_own")).first()[0] == stored.count()


def test_lowest_similarity_of_a_tile_is_one_row():
    import pyarrow as pa

    def table(docs, vecs, split):
        return pa.table({"doc_id": docs, "embedding": vecs, "cluster": [7] * len(docs), "split": split})

    whole = table([1, 1, 2, 3], [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0], [1.0, 1.0]], [False] * 4)
    assert C._low_tile((0, 0), whole, whole).to_pylist() == [{"cluster": 7, "a": None, "b": None, "low": 0.707107}]
    parts = C._low_tile((0, 1), whole, table([9], [[1.0, 0.0]], [True])).to_pylist()
    assert [(r["a"], r["b"], r["low"]) for r in parts] == [(1, 9, 1.0), (2, 9, 0.0), (3, 9, 0.707107)]


def test_document_pairs_come_out_of_their_task_once(spark, monkeypatch):
    """Documents of several sections, one of more sections than a block, against the plain computation; whole documents need no shuffle."""
    rng = np.random.default_rng(17)
    docs = [int(d) for d in np.r_[rng.integers(0, 60, 150), [7] * 45]]
    vecs = rng.normal(size=(len(docs), 6))
    vecs[30:40] = vecs[20:30] * 2
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    best = {}
    for i, j in itertools.combinations(range(len(docs)), 2):
        if docs[i] != docs[j]:
            pair = min(docs[i], docs[j]), max(docs[i], docs[j])
            best[pair] = max(best.get(pair, -1), round(float(unit[i] @ unit[j]), 6))
    df = spark.createDataFrame([(i, d, v.tolist()) for i, (d, v) in enumerate(zip(docs, vecs, strict=True))], "section_id long, doc_id long, embedding array<double>")
    for threshold in (-1.0, 0.2, 0.9):
        want = {p: s for p, s in best.items() if s >= threshold}
        for block_rows in (20, 64, 4096):
            found = S.best_pairs_above(C._under_documents(df), threshold, block_rows=block_rows)
            rows = found.collect()
            assert len(rows) == len(want) and {(r.left_id, r.right_id) for r in rows} == set(want)
            assert all(abs(want[r.left_id, r.right_id] - r.sim) < 2e-6 for r in rows)
    plan = C.document_pairs(df, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_pairs_that_reach_a_threshold_are_formed_exactly():
    rng = np.random.default_rng(5)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(700, 9)), rng.normal(size=(300, 9))))
    b[:9] = a[:9]
    sim = np.round(a @ b.T, 6)
    for threshold in (-1.0, 0.0, 0.3, 0.9, 1.0):
        i, j, s = S._reached(a, b, threshold, 6)
        assert (np.stack(np.nonzero(sim >= threshold)) == [i, j]).all() and (s == sim[i, j]).all()


def test_linkage_of_sections_over_blocks_and_rounds(spark, monkeypatch):
    """Sums meet in blocks; links between clusters that stayed are not formed again; the end is one task or rounds, with the same clusters."""
    rng = np.random.default_rng(21)
    v = np.repeat(rng.normal(size=(12, 5)), 6, axis=0) + 0.5 * rng.normal(size=(72, 5))
    docs = rng.integers(0, 40, 72)
    docs[::9] = 3
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    sim[docs[:, None] == docs[None, :]] = 0.0
    s = spark.createDataFrame([(i, int(docs[i]), v[i].tolist()) for i in range(72)], "section_id long, doc_id long, embedding array<double>")
    want, formed, sums = linkage(sim, 0.4, "average"), [], C._section_sums
    monkeypatch.setattr(C, "_section_sums", lambda rows, *a: formed.append(rows.where("merged").count()) or sums(rows, *a))
    for at_once, block_rows in ((0, 7), (60, 4096)):
        formed.clear()
        got = {r.section_id: r.cluster for r in C.average_linkage_of_sections(s, 0.4, block_rows, at_once).collect()}
        assert got == want and len(formed) > 1
        assert at_once or formed[-2] < formed[0] / 2
