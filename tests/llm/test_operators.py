"""The training-data operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import os
import random
import re
import sys
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import check
from knowhow.llm import exact_dedup, mixing, near_dedup, paragraph_dedup, passages, pieces, preference, quality, sharding, url_filter, vp_search
from knowhow.llm.common import deleted, positions, saved, thinned
from knowhow.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
LAYOUT = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, component_id long, digest string"


def lower(text):
    return (text or "").encode().lower()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (60, 80, 120, 3, 1, 40)]
    texts = [None, None, "", " \t\n", *base, base[0].upper(), base[0], "Ünï É", "ünï É", "ÜNÏ É"]
    for b in base[:3]:
        for _ in range(6):
            w = b.split()
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    texts += [f"line {i}\n{base[1]}\n{' '.join(r.choice(words) for _ in range(40))}" for i in range(4)]
    texts.append(" ".join(r.choice(words) for _ in range(30_000)))
    rows = [(i, t, "en", [None, "a", "b", "é"][i % 4], 0, -1, True, -5, "x") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base[2], "en", "a", 0, -1, True, -5, "x"), (None, None, "en", None, 0, -1, True, -5, "x")]
    return spark.createDataFrame(rows, LAYOUT).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], LAYOUT)


def test_exact_groups(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    assert len(got) == docs.count()
    by_sha = {}
    for r in got:
        by_sha.setdefault(r.text_sha256, []).append(r)
    assert sorted(map(len, by_sha.values())) == sorted(map(len, groups.values()))
    for rows in by_sha.values():
        most = max((r.doc_id for r in rows if r.doc_id is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in rows} == {(most, len(rows))} and sum(r.kept for r in rows) == 1
        assert next(r for r in rows if r.kept).doc_id == most
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(lower(r.text) for r in left.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_frequent_digests_are_settled_by_the_summary(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")), 256).alias("text_sha256"), F.col("id").alias("_row"))
    found = {r.text_sha256: (r._best.doc_id, r.group_size) for r in exact_dedup.frequent_digests(rows).collect()}
    hot = rows.where("doc_id = 0").first().text_sha256
    assert found[hot] == (19_998, 6_667)


def components(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingles(text, k):
    w = lower(text).split()
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups(docs, none, words):
    known = docs.where("doc_id IS NOT NULL")
    sets = {r.doc_id: shingles(r.text, words) for r in known.collect()}
    want = components(sets)
    got = near_dedup.near_groups(known, words).collect()
    assert len(got) == known.count()
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    left = near_dedup.drop_near_copies(docs, words)
    assert left.columns == docs.columns
    # A null doc_id ranks first: it stays for the copy of a text and, without words, for itself.
    ids = [r.doc_id for r in left.collect()]
    assert len(ids) - ids.count(None) == len({c for k, c in want.items()}) - 1 and ids.count(None) == 2
    assert near_dedup.near_groups(none).count() == 0 and near_dedup.drop_near_copies(none).count() == 0


def test_hot_family_of_near_copies(spark):
    r = random.Random(3)
    base = [f"t{r.randrange(5000)}" for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(60)] = f"t{r.randrange(5000)}"
        rows.append((i, " ".join(w)))
    want = components({i: shingles(t, 2) for i, t in rows})
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_registers_and_correction():
    least = np.array([1, 1 << 63, 3 << 40], np.uint64)
    assert near_dedup.hyper_registers(least).tolist() == [63 << 10, 0, (22 << 10) | 512]
    r = np.random.default_rng(1)
    hashes = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    from knowhow.llm.shingles import minima, pack
    a, b = np.unique(hashes[:2000]), np.unique(hashes[1000:])
    sig = [pack(near_dedup.hyper_registers(minima(x, np.array([0, len(x)]), 128)), 4, 16) for x in (a, b)]
    assert abs(near_dedup.HYPER.estimate(sig[0], sig[1], 2000.0, 2000.0)[0] - 1 / 3) < 0.15


def test_repeated_paragraphs(docs, none):
    known = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    sets, where = {}, {}
    for r in known.collect():
        for k, line in enumerate(x for x in (r.text or "").split("\n") if x):
            if len(line.split()) >= 25:
                sets[r.doc_id, k] = shingles(line, 5)
                where[r.doc_id, k] = line
    first = components(sets)
    size = {c: list(first.values()).count(c) for c in first.values()}
    want = {k: (*c, size[c], k != c) for k, c in first.items() if size[c] > 1}
    got = paragraph_dedup.repeated_paragraphs(known).collect()
    assert {(r.doc_id, r.paragraph): (r.keep_doc_id, r.keep_paragraph, r.occurrences, r.removed) for r in got} == want and want
    text = {r.doc_id: r.text for r in known.collect()}
    assert all(text[r.doc_id][r.start : r.end] == where[r.doc_id, r.paragraph] for r in got)
    assert paragraph_dedup.repeated_paragraphs(none).count() == 0 and paragraph_dedup.repeated_paragraphs(docs).count() > len(got)


def test_repeated_passages(spark, none, tmp_path):
    r = random.Random(3)

    def run(n):
        return [r.choice(["wörd", "Ünit", "line", "Other", "x"]) + str(r.randrange(300)) for _ in range(n)]

    a, b, c = run(60), run(51), run(50)
    texts = [
        " ".join(run(30) + a + run(40)), "é " + " ".join(run(70) + a).upper().replace("Ö", "ö"),  # inside longer lines
        "\n".join(" ".join(a[i : i + 7]) for i in range(0, 60, 7)), " ".join(a[:33]) + "\n\n\t" + " ".join(a[33:]),  # lines cut elsewhere
        " ".join(run(9) + b), " ".join(b + run(9)), " ".join(run(9) + c), " ".join(c + run(9)),  # 51 words, 50 words
        "ha " * 120, "tick tock " * 60, " ".join(run(20) + a + run(5) + a[:55]), None, "", " ".join(a + b),
    ]
    texts += [texts[0], " ".join(run(40_000) + b)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    places = {}
    for i, t in enumerate(texts):
        w = lower(t).split()
        for p in range(len(w) - 50):
            places.setdefault(tuple(w[p : p + 51]), []).append((i, p))
    want = {x: v[0] for v in places.values() if len(v) > 1 for x in v}
    edges = [[m.span() for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", t or "")] for t in texts]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [x for x in QUERIES["op10_paragraph_dedup"](spark, str(tmp_path)).collect() if "passage" in x and x["passage"]]
    got = {}
    for x in rows:
        first = [s for s, _ in edges[x.doc_id]].index(x.start)
        assert edges[x.doc_id][first + x.words - 1][1] == x.end
        assert x.paragraph == len([y for y in texts[x.doc_id][: x.start].split("\n")[:-1] if y])
        for p in range(first, first + x.words - 50):
            assert (x.doc_id, p) not in got
            got[x.doc_id, p] = (x.keep_doc_id, x.removed)
    assert got == {k: (v[0], v != k) for k, v in want.items()}
    assert {x.doc_id for x in rows} == {0, 1, 2, 3, 4, 5, 8, 9, 10, 13, 14, 15}
    assert passages.repeated_passages(none).count() == 0


def test_windows_are_rows_only_for_large_anchors(spark, monkeypatch):
    r = random.Random(5)
    shared = [[f"w{r.randrange(900)}" for _ in range(90)] for _ in range(6)]
    texts = []
    for _ in range(60):
        x, y = r.choices(shared, k=2)
        texts.append(" ".join([f"n{r.randrange(9000)}" for _ in range(20)] + x[r.randrange(20) :] + ["é"] + y[: 90 - r.randrange(20)]))
    texts += ["ha " * 130, "tick tock " * 60 + "x", "tick tock " * 60]
    docs = spark.createDataFrame([(None if i % 9 == 4 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows, found = [], []
    saved = passages.saved

    def counted(df, name):
        out = saved(df, name)
        if name == "windows":
            rows.append(out.count())
        return out

    monkeypatch.setattr(passages, "saved", counted)
    for together, slot in [(passages.TOGETHER, passages.SLOT), (passages.TOGETHER, 40), (60, 40), (0, 40)]:
        monkeypatch.setattr(passages, "TOGETHER", together)
        monkeypatch.setattr(passages, "SLOT", slot)
        found.append(sorted(map(repr, passages.repeated_passages(docs).collect())))
    assert rows[:2] == [0, 0] and 0 < rows[2] < rows[3]
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) > 60


def test_only_members_of_shared_buckets_go_on(spark):
    from types import SimpleNamespace

    from knowhow.llm import linking
    from knowhow.llm.common import bitmap

    r = np.random.default_rng(2)
    sig = r.integers(-(1 << 62), 1 << 62, (500, 16))
    sig[3], sig[7, 2], sig[9, 2], sig[11, 5] = sig[4], sig[8, 2], sig[8, 2], sig[8, 2]  # the last in another band
    shared = [(b, int(sig[3, b])) for b in range(16)] + [(2, int(sig[8, 2]))]
    buckets = spark.createDataFrame(shared, "band int, key long")
    bits = SimpleNamespace(value=bitmap(buckets.mapInArrow(linking._names(16), "name long"), linking.BITS))
    rows = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(sig.tolist())], ["id", "sig"])
    got = {(x["id"], x["band"], x["key"]) for t in linking._met(bits)([rows]) for x in t.to_pylist()}
    want = {(i, b, int(sig[3, b])) for i in (3, 4) for b in range(16)} | {(i, 2, int(sig[8, 2])) for i in (7, 8, 9)}
    assert want <= got and len(got - want) < 5


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_thinned_keeps_what_is_wanted(spark, bits):
    docs = spark.createDataFrame([(i if i else None, str(i)) for i in range(3000)], "doc_id long, text string")
    wanted = docs.where("doc_id IS NULL OR doc_id % 7 = 0").select("doc_id")
    got = [r["doc_id"] for r in thinned(docs, "doc_id", wanted, bits).collect()]
    assert {r["doc_id"] for r in wanted.collect()} <= set(got) and len(got) == len(set(got))
    assert len(got) < 450 if bits > 64 else len(got) == 3000
    assert thinned(docs, "doc_id", wanted.limit(0), bits).count() == 0


def test_deleted_tables_leave_others(spark, tmp_path):
    gone, stays, empty = (saved(spark.range(n), "a table") for n in (5, 7, 0))
    files = gone.inputFiles() + empty.inputFiles()
    deleted(gone, empty)
    assert stays.count() == 7 and files and not any(os.path.exists(unquote(urlparse(x).path)) for x in files)


def test_positions_in_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.lit(None)).alias("k"), (F.col("id") % 7).alias("v"), F.col("id"))
    got = positions(df, ["k"], ["v", "id"], "pos").collect()
    for k in ("hot", None):
        rows = sorted((r for r in got if r.k == k), key=lambda r: (r.v, r.id))
        assert [r.pos for r in rows] == list(range(len(rows)))


def test_mixing(docs, none):
    got = mixing.mix_counts(docs, carry={"from": F.col("source")}).collect()
    source = {}
    for r in got:
        source.setdefault((r["from"], r.source_size, r.target), []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(t for *_, t in source) - 1.5 * total) < 1e-6 * total and len(got) == docs.count()
    for (_, size, target), rows in source.items():
        assert target <= 2 * size and all(r.taken <= 2 * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)
    again = mixing.mix_counts(docs.repartition(3), carry={"from": F.col("source")})
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_counts(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def least_capacity(sizes, shards):
    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_smallest_capacity(spark, digits):
    r = random.Random(digits)
    groups = sorted((f"{r.getrandbits(64):016x}", r.choice([1, 5, 30, 200])) for _ in range(700))
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "digest string, bytes long"), 8, digits)
    assert capacity == least_capacity([s for _, s in groups], 8) and cuts == sorted(cuts)
    load = [0] * 8
    for d, s in groups:
        load[sum(d >= c for c in cuts)] += s
    assert max(load) <= capacity


def test_shards(docs, none):
    got = sharding.shard_rows(docs).collect()
    text = {}
    for r, d in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id)), strict=True):
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode()))
            assert text.setdefault(d.text or "", r.shard) == r.shard
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_rows(none).count() == 0


def rule_of(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        at, start = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "https://example.com/en/2", "http://xexample.com/en/", "http://a.net/es/1", "http://net/fr/2",
            "http://a.org/es/9", "http://b.org/en/9", "http://c.com?x/", "http://É.COM/a#b", "ftp://x.net/" + "z" * 20_000, "http://a.net/es/1"]
    urls += [f"http://s{i}.net/{'es' if i % 2 else 'fr'}/{i}" for i in range(40)] + [f"http://s{i}.com/en/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "html", "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, verdict string")
    got = url_filter.judge_urls(pages, url_filter.labelled_urls(pages)).orderBy("page_id").collect()
    assert len(got) == len(urls)
    for r, u in zip(got, urls, strict=True):
        rest = (u or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (host, path), u
        m = rule_of(host, path)
        assert r.rule == (m[0] if m else None) and (not m or r.verdict == m[1]) and r.verdict in ("allow", "block")
    verdict = {u: r.verdict for u, r in zip(urls, got, strict=True)}
    assert verdict["http://a.org/es/9"] == "block" and verdict["http://b.org/en/9"] == "allow"
    assert url_filter.judge_urls(pages.limit(0), url_filter.labelled_urls(pages.limit(0))).count() == 0


def test_nearest_is_exact_at_factor_one(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 12)) * r.uniform(0.2, 3, (900, 1))
    x[100:160] = x[100]
    rows = [(i, [float(c) for c in v], "l") for i, v in enumerate(x)]
    rows += [rows[0], (900, None, "l"), (901, [0.0] * 12, "l"), (902, [None] + [1.0] * 11, "l"), (903, [float("nan")] + [1.0] * 11, "l"), (904, [float("inf")] + [1.0] * 11, "l"), (905, [], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = vp_search.nearest(df, df.where("vec_id % 20 = 0"), factor=1.0, shard_rows=250, query_rows=10).orderBy("query_id", "rank").collect()
    want = []
    for q in range(0, 900, 20):
        s = (x * x[q]).sum(axis=1)
        near = np.lexsort((np.arange(900), -s))
        want += [(q, k + 1, int(i), float(s[i])) for k, i in enumerate(near[near != q][:20])]
    assert [tuple(g) for g in got] == want
    loose = vp_search.nearest(df, df.where("vec_id % 20 = 0"), factor=1.3, shard_rows=250).collect()
    assert len({(g.query_id, g.vec_id) for g in loose} & {w[:1] + w[2:3] for w in want}) >= 0.9 * len(want)
    few = df.where("vec_id IN (0, 3, 20)")
    assert vp_search.nearest(few, few.where("vec_id % 20 = 0")).count() == 4 and vp_search.nearest(df.limit(0), df.limit(0)).count() == 0


def test_network_learns_and_covers_the_whole_text():
    r = random.Random(5)
    good = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randint(20, 200))) for _ in range(150)]
    bad = [t[: len(t) // 2] + " $$%% " * 20 + t[len(t) // 2 :] for t in good]
    texts = [t.encode() for t in good + bad]
    net = quality.fit(texts[:100] + texts[150:250], [1] * 100 + [0] * 100, 0.5, rounds=8)
    tables = net.tables()
    s = [net.score(t, tables) for t in texts]
    assert np.mean([x > 0 for x in s[100:150]]) > 0.9 and np.mean([x < 0 for x in s[250:]]) > 0.9
    long = good[0] * 400
    assert net.score((long + " $$%% " * 20).encode(), tables) < net.score(long.encode(), tables)
    text = bytes(range(256)) * 9
    c = quality.chunks_of(text)
    assert b"".join([c[0].tobytes(), *[x.tobytes()[quality.OVERLAP :] for x in c[1:]]])[: len(text)] == text


def test_quality_scores(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels, per_class=10).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0 and quality.keep_good(docs, labels).columns == docs.columns


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="needs the vocabulary file")
def test_pieces(docs, none, spark):
    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    p = pieces.Pieces(model)
    got = {r.doc_id: r for r in pieces.encode_documents(docs.where("doc_id IS NOT NULL"), giant=300, chunk=64).collect()}
    for r in docs.where("doc_id IS NOT NULL").collect():
        ids = p.path(pieces.marked(r.text or ""))
        score = [sum(p.score.get(x, 0) for x in (bytes(p.bytes[i]).decode("utf-8", "replace").replace(" ", "▁") for i in y)) for y in (ids, got[r.doc_id].token_ids)]
        assert score[0] == score[1] and got[r.doc_id].round_trip and got[r.doc_id].n_tokens == len(got[r.doc_id].token_ids)
    texts = {r.doc_id: r.text for r in pieces.decode_documents(spark.createDataFrame(list(got.values()))).collect()}
    assert all(texts[r.doc_id] == (r.text or "") for r in docs.where("doc_id IS NOT NULL").collect())
    assert pieces.encode_documents(none).count() == 0 and pieces.encode_documents(docs).count() == docs.count()


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="needs the vocabulary file")
def test_best_path_against_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    p, m = pieces.Pieces(model), pb.ModelProto()
    m.ParseFromString(model)
    m.trainer_spec.model_type = 1  # best path by score
    for x in m.pieces:
        x.score = x.score if x.score > -1e8 else p.unknown + 9
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for text in ["hello world", "The quick  brown fox", "Größe über été", "x", "a" * 50, "日本語 text", "price: 12.50$"]:
        assert p.path(pieces.marked(text)) == library.encode(text)
    a, b, c = (np.random.default_rng(4).integers(-9, 9, (3, 1, 5, 5))).astype(float)
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


def test_preference_pairs(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q <|im_end|>"), (1, 2, "assistant", "good"), (1, 3, "user", "late"), (2, 0, "user", None), (2, 1, "assistant", "other"), (3, 0, "user", "alone"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, n_common int, usable boolean")
    got = {r.pair_id: r for r in preference.preference_pairs(*preference.swapped_replies(df)).collect()}
    r = got[1]
    assert r.n_common == 2 and r.prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq <‍|im_end|><|im_end|>\n" and r.usable
    assert r.chosen == "<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nlate<|im_end|>\n" and [r.chosen[a:b] for a, b in r.chosen_mask] == ["good<|im_end|>"]
    assert r.rejected != r.chosen and [r.rejected[a:b].endswith("<|im_end|>") for a, b in r.rejected_mask] == [True]
    assert got.keys() == {1, 2, 3, None} and got[None].usable and not got[3].usable and got[3].chosen == got[3].rejected == ""
    same = preference.turns_of(df.where("conv_id = 1")).withColumnRenamed("conv_id", "pair_id")
    r = preference.preference_pairs(same, same).first()
    assert r.n_common == 4 and r.chosen == r.rejected == "" and not r.usable
    assert preference.preference_pairs(*preference.swapped_replies(df.limit(0))).count() == 0


def test_preference_pairs_against_brute_force(spark):
    r = random.Random(8)
    talks = {k: [(r.choice(["user", "assistant", "system"]), r.choice(["", "a", "b", "c|", "<|x"])) for _ in range(r.randrange(1, 9))] for k in [*range(60), None]}
    rows = [(k, i, *t) for k, talk in talks.items() for i, t in enumerate(talk)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    sides = [{x.pair_id: [(t["role"], t["text"]) for t in x.turns] for x in side.collect()} for side in preference.swapped_replies(df)]
    chosen, rejected = sides
    assert chosen == talks and rejected.keys() == talks.keys()
    order = [k for k in [*range(60), None] if any(role == "assistant" for role, _ in talks[k])]

    def tails(talk):
        return [talk[i:] for i, (role, _) in enumerate(talk) if role == "assistant"]

    for k in talks:
        if k not in order:
            assert rejected[k] == talks[k]
            continue
        other = talks[order[(order.index(k) + 1) % len(order)]]
        assert any(rejected[k] == talks[k][:i] + t for i, (role, _) in enumerate(talks[k]) if role == "assistant" for t in tails(other))
    assert any(len(rejected[k]) > len(os.path.commonprefix([rejected[k], talks[k]])) + 1 < len(talks[k]) for k in order)

    def render(turns):
        return "".join(f"<|im_start|>{role}\n{text.replace('<|', '<' + chr(8205) + '|')}<|im_end|>\n" for role, text in turns)

    got = preference.preference_pairs(*preference.swapped_replies(df)).collect()
    assert len(got) == len(talks)
    for x in got:
        n = len(os.path.commonprefix([chosen[x.pair_id], rejected[x.pair_id]]))
        assert x.n_common == n and x.prompt == render(chosen[x.pair_id][:n])
        ends = [(chosen[x.pair_id][n:], x.chosen, x.chosen_mask), (rejected[x.pair_id][n:], x.rejected, x.rejected_mask)]
        for rest, text, mask in ends:
            assert text == render(rest) and [text[a:b] for a, b in mask] == [render([t]).split("\n", 1)[1][:-1] for t in rest if t[0] == "assistant"]
        assert x.usable == all(any(role == "assistant" for role, _ in rest) for rest, *_ in ends)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = check.connect(FOLDER)
    ok, note = check.compare(spark, con, name, FOLDER, SQL[name])
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_pipeline(spark, tmp_path):
    sys.path.insert(0, os.path.dirname(check.__file__))
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if name != "encoding":
            assert new.columns == docs.columns and new.count() > 0
        if name == "exact_dedup":
            want = {}
            for r in docs.collect():
                want[lower(r.text)] = max(want.get(lower(r.text), -1), r.doc_id)
            assert sorted(r.doc_id for r in new.collect()) == sorted(want.values())
        if name == "near_dedup":
            want = components({r.doc_id: shingles(r.text, 5) for r in docs.collect()})
            assert sorted(r.doc_id for r in new.collect()) == sorted(set(want.values()))
        if name == "encoding":
            assert new.count() == docs.count() and new.where("NOT round_trip").count() == 0
        docs = new


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
