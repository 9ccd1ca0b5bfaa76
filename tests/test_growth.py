"""Steps that must not form a row per pair or per authorship and term, against the plain computation."""

from collections import defaultdict
from math import isclose, sqrt

import numpy as np

from knowhow.operators import fulltext, inverted, network, people, similarity, term_tiles, themes


def _texts(seed=3, docs=60, people=25):
    rng = np.random.default_rng(seed)
    rows = [(d, f"w{t}", int(rng.integers(1, 9))) for d in range(docs) for t in np.unique(rng.zipf(1.4, 30) % 200)]
    authors = sorted({(int(rng.integers(0, docs + 5)), int(rng.integers(0, people))) for _ in range(150)})
    raw = defaultdict(lambda: defaultdict(int))
    of = defaultdict(list)
    for d, e in authors:
        of[d].append(e)
    for d, t, n in rows:
        for e in of[d]:
            raw[e][t] += n
    return rows, authors, raw


def test_person_totals_over_parts_and_groups(spark):
    rows, authors, raw = _texts()
    out = term_tiles.person_totals(
        spark.createDataFrame(rows, "doc_id long, term string, w long"), spark.createDataFrame(authors, "doc_id long, emp_id long"), block_rows=40).collect()
    assert {r.emp_id for r in out} == set(raw)
    for r in out:
        values = raw[r.emp_id].values()
        assert (r.terms, r.total, r.top) == (len(values), sum(values), max(values)) and isclose(r.length, sqrt(sum(v * v for v in values)))


def test_sums_do_not_depend_on_the_step(spark):
    import pyarrow as pa

    rows, authors, raw = _texts(5)
    terms = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("doc_id", "term", "w"))})
    people = pa.table({k: [a[i] for a in authors] for i, k in enumerate(("doc_id", "emp_id"))})
    for step in (1, 7, 1 << 20):
        ids, words, found = term_tiles._sums(terms, people, step)
        got = {(ids[e], words[int(t)].as_py()): v for part in found for e, t, v in zip(*part, strict=True)}
        assert got == {(e, t): v for e, ts in raw.items() for t, v in ts.items()}


def test_leading_terms_over_parts_and_groups(spark):
    rows, authors, raw = _texts(7)
    out = term_tiles.leading_terms(
        spark.createDataFrame(rows, "doc_id long, term string, n long"), spark.createDataFrame(authors, "doc_id long, emp_id long"), 5, block_rows=40).collect()
    got = defaultdict(dict)
    for r in out:
        assert raw[r.emp_id][r.term] == r.n and r.term not in got[r.emp_id]
        got[r.emp_id][r.term] = r.n
    assert set(got) == set(raw)
    for e, terms in raw.items():
        first = lambda ts: sorted(ts.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert first(got[e]) == first(terms)
    assert len(out) < sum(map(len, raw.values()))


def _small_network(spark):
    rows, authors, _ = _texts(11)
    rng = np.random.default_rng(1)
    ids = sorted({e for _, e in authors})
    frame = spark.createDataFrame
    return dict(
        egos=frame([(e,) for e in ids[:6]], "emp_id long"), people=frame([(e, e % 3) for e in ids], "emp_id long, dept_id long"),
        profiles=frame([(e, rng.normal(size=4).tolist()) for e in ids[1:]], "emp_id long, vec array<double>"),
        theme=frame([(e, f"k{k}", float(rng.random())) for e in ids for k in range(4)], "emp_id long, term string, weight double"),
        words=frame(rows, "doc_id long, term string, n long").repartition("doc_id"), n_docs=frame([(70,)], "n_docs long"),
        departments=frame([(d, f"D{d}", f"site{d % 2} func{d}課", "plant") for d in range(3)], "dept_id long, dept_code string, dept_name string, dept_type string"),
        authors=frame(authors, "doc_id long, emp_id long"))


def test_egos_with_many_terms_stay_on_the_short_way(spark, monkeypatch):
    x = _small_network(spark)
    x["lengths"] = term_tiles.person_totals(x["words"], x["authors"], n_docs=70).select("emp_id", "length")
    weights = people.document_weights(x["words"], x["n_docs"])
    want = {(r.emp_id, r.other_id): r.sim for r in people.text_closeness(x["egos"], weights, x["authors"]).collect()}

    def close():
        got = network.text_closeness(x["egos"], x["words"], x["n_docs"], x["authors"], x["lengths"]).collect()
        return {(r.emp_id, r.other_id): r.sim for r in got}

    whole, near = close(), network.Network.of(**x).nearest(top_n=3).orderBy("emp_id", "position").collect()
    monkeypatch.setattr(network, "TERM_ROWS", 20)
    monkeypatch.setattr(network, "DENSE_TERMS", 0)
    monkeypatch.setattr(people, "_match", None)  # the pair-wise way
    for got in (whole, close()):
        assert set(got) == set(want) and all(isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    again = network.Network.of(**x).nearest(top_n=3).orderBy("emp_id", "position").collect()
    assert [(r.emp_id, r.other_id, r.score) for r in again] == [(r.emp_id, r.other_id, r.score) for r in near] and len(near) == 18


def test_best_sections_without_a_row_per_posting_and_query(spark, monkeypatch):
    rows = [(i, i // 4, f"alpha beta beta word{i % 7} word{i % 3} rare{i}") for i in range(300)]
    index = inverted.postings(spark.createDataFrame(rows, "section_id long, doc_id long, body string")).cache()
    asked = [(q, t) for q in range(30) for t in ("alpha", "beta", f"word{q % 7}", f"rare{q}", "nowhere")] + [(40, "nowhere"), (41, "rare299")]
    asked = spark.createDataFrame(asked, "query_id long, term string")
    want = sorted(map(tuple, fulltext.ranked(inverted.search(index, asked), 9).collect()))
    monkeypatch.setattr(inverted, "search", None)
    for cells in (1 << 22, 0):
        monkeypatch.setattr(network, "DENSE_CELLS", cells)
        assert sorted(map(tuple, inverted.best(index, asked, 9).collect())) == want
    assert {r[0] for r in want} == set(range(30)) | {41}


def test_nearness_forms_its_pairs_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(d, rng.normal(size=4).tolist()) for d in range(40)], "doc_id long, vec array<double>")
    authors = spark.createDataFrame([(d, d % 7) for d in range(900)], "doc_id long, emp_id long")
    runs, joined = spark.sparkContext.accumulator(0), []
    top = themes.similarity.self_top_k

    def counted(rows, k, **opts):
        joined.append(rows)

        def count(batches):
            runs.add(1)
            yield from batches

        out = top(rows, k, **opts).coalesce(1)
        return out.mapInArrow(count, out.schema)

    monkeypatch.setattr(themes.similarity, "self_top_k", counted)
    near = themes.nearness(docs, authors)
    unique = themes.uniqueness(near).collect()
    assert runs.value == 1 and len(unique) == 40 and joined[0].count() == 40
    for limit in (10, 1000):
        monkeypatch.setattr(themes, "SENT_IDS", limit)
        assert {r.id: r.grp for r in themes._with_authors(docs, authors).collect()} == {d: [d % 7] for d in range(40)}


def test_best_of_groups_sends_one_score_a_group(spark):
    rng = np.random.default_rng(4)
    left = spark.createDataFrame([(q, rng.normal(size=5).tolist()) for q in range(4)], "id long, vec array<double>")
    right = spark.createDataFrame([(i, i % 30, rng.normal(size=5).tolist()) for i in range(300)], "id long, grp long, vec array<double>")
    every = similarity.score_all(left, right).join(right.selectExpr("id right_id", "grp"), "right_id").groupBy("left_id", "grp").agg({"sim": "max"})
    want = sorted(map(tuple, every.collect()))
    for rows in (4096, 2):
        assert sorted(map(tuple, similarity.best_of_groups(left, right, block_rows=rows).collect())) == want
    assert len(want) == 120


def test_parts_of_terms_lie_few_to_a_file_and_are_packed_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    rows = [(d, f"word{(d * 7 + t * t) % 500}", 1.0 + t % 3) for d in range(400) for t in range(40)]
    stored = term_tiles._parts(spark.createDataFrame(rows, "doc_id long, term string, w double").repartition(2), 64)
    files = stored.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 12 and max(r["count"] for r in files) < 16 and stored.count() == stored.select("part").distinct().count()
    found = [row for r in stored.collect() for row in term_tiles.blocks.opened(pa_binary(r.rows)).to_pylist()]
    assert sorted((r["doc_id"], r["term"], r["w"]) for r in found) == sorted(rows)
    assert stored.selectExpr("sum(length(rows)) n").first().n < 16 * len(rows)


def pa_binary(data):
    import pyarrow as pa

    return pa.scalar(bytes(data), pa.binary())


def test_leading_terms_leave_a_task_once_a_person(spark, monkeypatch):
    rows, authors, raw = _texts(13)
    frames = spark.createDataFrame(rows, "doc_id long, term string, n long"), spark.createDataFrame(authors, "doc_id long, emp_id long")
    monkeypatch.setattr(term_tiles, "STEP", 10)
    out = term_tiles.leading_terms(*frames, 3, block_rows=40).collect()
    first = lambda ts: sorted(ts.items(), key=lambda x: (-x[1], x[0]))[:3]
    for e, terms in raw.items():
        assert first({r.term: r.n for r in out if r.emp_id == e}) == first(terms)
    assert len(out) <= 4 * 3 * len(raw)  # not three for each of the 33 parts
