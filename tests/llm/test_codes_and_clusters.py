"""Vector codes, centroid clustering and byte-level BPE against brute force and the tokenizer library."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from knowhow.llm import byte_bpe, centroids, common, grids, orchard_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, key string, v string, cluster int, error string"


def cells(vector):
    return [int(np.floor(256 * float(np.float32(x)))) for x in vector]


def nearest(x, entries):
    d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
    return d.index(min(d)), min(d)


def moved(entries, owner, xs):
    out = []
    for e, old in enumerate(entries):
        mine = [x for x, o in zip(xs, owner, strict=True) if o == e]
        out.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else old)
    return out


def digest(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(3)
    centres = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    good = [(i, [c + r.gauss(0, 0.2) for c in centres[i % 6]], None if i % 5 == 0 else i % 3) for i in range(260)]
    good += [good[7], good[7], (900, good[8][1], 1), (901, [0.0] * 64, None), (902, [0.25] * 64, 4), (903, [-0.25] * 64, 4), (None, good[9][1], 2)]
    bad = [(1000, None, 1), (1001, [], 1), (1002, [0.5] * 63, 1), (1003, [None] + [0.1] * 63, 1), (1004, [float("nan")] + [0.1] * 63, 1),
           (1005, [float("inf")] + [0.1] * 63, 1), (-1, [1e30] + [0.1] * 63, 1), (1006, [0.5] * 128, 1)]
    rows = [(*x, "x", "k", "v", -1, "e") for x in good + bad]
    return spark.createDataFrame(rows, VECTORS).repartition(4), good


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], VECTORS)


def test_vector_codes(vectors):
    df, good = vectors
    xs = [cells(v) for _, v, _ in good]
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, xs[i]))
    books = [[xs[i][4 * p : 4 * p + 4] for i in order[:64]] for p in range(16)]
    parts = [[x[4 * p : 4 * p + 4] for x in xs] for p in range(16)]
    for _ in range(2):
        books = [moved(books[p], [nearest(x, books[p])[0] for x in parts[p]], parts[p]) for p in range(16)]
    found = [[nearest(parts[p][i], books[p]) for p in range(16)] for i in range(len(good))]
    errors = [sum(d for _, d in f) for f in found]
    per = {}
    for (_, _, label), e in zip(good, errors, strict=True):
        per[label] = per.get(label, 0) + e
    sha = digest(c for b in books for e in b for c in e)
    want = [(g[0], "".join(f"{e:02x}" for e, _ in f), err, per[g[2]], sha) for g, f, err in zip(good, found, errors, strict=True)]
    got = [tuple(r) for r in orchard_codes.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_orchard_search_equals_brute_force_with_ties_and_equal_entries():
    r = np.random.default_rng(0)
    books = r.integers(-3, 4, (3, 40, 2))
    books[:, 20:25] = books[:, :5]
    x = r.integers(-4, 5, (500, 6))
    entry, d = orchard_codes.Orchard(books).search(x)
    full = ((x.reshape(500, 3, 1, 2) - books[None]) ** 2).sum(axis=3)
    assert (entry == full.argmin(axis=2)).all() and (d == full.min(axis=2)).all()
    one, zero = orchard_codes.Orchard(books[:, :1]).search(x)
    assert (one == 0).all() and (zero == full[:, :, 0]).all()


def test_orchard_search_measures_few_entries():
    r = np.random.default_rng(1)
    books = r.integers(-200, 200, (1, 64, 4))

    class Counting(np.ndarray):
        rows = 0

        def __getitem__(self, item):
            if isinstance(item, np.ndarray):
                Counting.rows += len(item)
            return np.asarray(super().__getitem__(item))

    tree = orchard_codes.Orchard(books)
    tree.flat = tree.flat.view(Counting)
    tree.search(books[0][r.integers(0, 64, 1000)] + r.integers(-20, 20, (1000, 4)))
    assert Counting.rows < 0.5 * 64 * 1000


def test_vector_codes_of_few_and_no_vectors(spark, vectors, none):
    assert orchard_codes.vector_codes(none).count() == 0
    assert orchard_codes.vector_codes(vectors[0].where("vec_id >= 1000 and vec_id < 1002")).count() == 0
    few = orchard_codes.vector_codes(vectors[0].where("vec_id in (901, 902, 903)"))
    assert sorted((r.vec_id, r.code, r.error) for r in few.collect()) == [(901, "00" * 16, 0), (902, "01" * 16, 0), (903, "02" * 16, 0)]


def test_decoded_vectors_lie_as_near_as_the_error_says(vectors):
    df, good = vectors
    books = orchard_codes.codebooks(df)
    coded = orchard_codes.vector_codes(df, books=books)
    back = {r.vec_id: r.embedding for r in orchard_codes.decoded_vectors(coded, books).collect()}
    error = {r.vec_id: r.error for r in coded.collect()}
    for i, v, _ in good:
        on_cells = [int(np.floor(256 * x)) for x in back[i]]
        assert sum((a - b) ** 2 for a, b in zip(on_cells, cells(v), strict=True)) == error[i]


def test_clusters(vectors):
    df, good = vectors
    xs = [cells(v) for _, v, _ in good]
    name = [None if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest() for i, _, _ in good]
    order = sorted(range(len(good)), key=lambda i: (name[i] is None, name[i] or "", xs[i]))
    centres = [xs[i] for i in order[:40]]
    for _ in range(5):
        centres = moved(centres, [nearest(x, centres)[0] for x in xs], xs)
    found = [nearest(x, centres) for x in xs]
    per = {}
    for c, d in found:
        per[c] = per.get(c, 0) + d
    want = [(g[0], c, d, per[c], sum(per.values()), digest(centres[c])) for g, (c, d) in zip(good, found, strict=True)]
    got = [tuple(r) for r in centroids.clustered(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sorted_lists_equal_brute_force_with_ties_and_equal_centroids():
    r = np.random.default_rng(2)
    for k, width in ((1, 3), (7, 1), (30, 3), (40, 8)):
        c = r.integers(-4, 5, (k, width))
        c[k // 2 :] = c[: k - k // 2]
        x = r.integers(-6, 7, (400, width))
        number, best = centroids.SortedLists(c).nearest(x)
        full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (number == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


def test_clusters_of_few_and_no_vectors(vectors, none):
    assert centroids.clustered(none).count() == 0
    few = centroids.clustered(vectors[0].where("vec_id in (901, 902, 903, 1000)")).collect()
    assert {r.cluster for r in few} == {0, 1, 2} and {(r.distance, r.inertia) for r in few} == {(0, 0)}


def test_largest_components_do_not_overflow():
    for width in (1, 4, 64):
        m = grids.largest(width)
        assert 4 * width * (2 * m) ** 2 < 2**63
    books = np.array([[[grids.largest(4)] * 4, [-grids.largest(4)] * 4]])
    entry, d = orchard_codes.Orchard(books).search(-books[0])
    assert entry.ravel().tolist() == [1, 0] and d.ravel().tolist() == [0, 0]
    assert grids.on_grid(__import__("pyarrow").array([[1.0], [2.0**30]]), 1, grids.largest(1))[0].tolist() == [0]


def test_totals_of_frequent_and_rare_keys(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("often")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("name"),
        F.col("id").alias("x"))
    got = {r.name: (r.n, r.total, r.low) for r in common.with_totals(rows, "name", "x", "total").groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.max("total").alias("total"), F.min("total").alias("low")).collect()}
    want = {r.name: (r.n, r.t, r.t) for r in rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("t")).collect()}
    assert got == want


LAYOUT = "doc_id long, text string, word string, n long, block string, at int, ids array<int>, words string"


@pytest.fixture(scope="module")
def library():
    ranks, pattern = byte_bpe.vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    pool = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "漢", "1", "２", "!", "\x1c", "\x85", "\xa0", "　", "​", "😀", "́", "X", "'ll", "\r", "the ", " of"]
    some = ["".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(300)]
    some += [None, "", " ", "   ", "<|endoftext|> don't", "x" * 70_000, "ab " * 60_000, " " * 70_000 + "end", "The same text.", "The same text."]
    rows = list(enumerate(some)) + [(3, some[3]), (None, "no id"), (None, None)]
    return [(i, t, "w", 1, "b", 0, [1], "z") for i, t in rows]


def test_ids_equal_the_library_and_decode_to_the_text(spark, library, texts):
    df = spark.createDataFrame(texts, LAYOUT).repartition(3)
    for size in (4 << 20, 2_000):
        coded = byte_bpe.encode_words(df, block_size=size)
        got = byte_bpe.decode_words(coded).collect()
        want = [(t[0], library.encode_ordinary(t[1] or ""), (t[1] or "").encode()) for t in texts]
        assert sorted(((r.doc_id, r.token_ids, bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)


def test_no_documents_and_only_empty_ones(spark):
    assert byte_bpe.decode_words(byte_bpe.encode_words(spark.createDataFrame([], LAYOUT))).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.token_ids) for r in byte_bpe.encode_words(blank).collect()) == [(1, []), (2, []), (3, [])]


def test_decoding_of_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, [64, None, 10**8, -1, 65], "x")], "doc_id long, token_ids array<int>, more string")
    got = {r.doc_id: r for r in byte_bpe.decode_words(rows).collect()}
    ranks, _ = byte_bpe.vocabulary()
    token = {i: t for t, i in ranks.items()}
    assert got[1].decoded is None and bytes(got[2].decoded) == b"" and bytes(got[3].decoded) == token[64] + token[65] and got[3].more == "x"


def test_words_are_cut_the_same_in_stretches(library):
    import regex

    r = random.Random(9)
    find = regex.compile(library._pat_str).findall
    for _ in range(2000):
        t = "".join(r.choice(["a", " ", "\n", "'s", "1", "!", "\xa0", "é"]) for _ in range(r.randint(0, 50)))
        assert [w for s in byte_bpe.stretches(t, 4) for w in find(s)] == find(t)


def test_merging_equals_the_library(library):
    r = random.Random(11)
    ranks, _ = byte_bpe.vocabulary()
    for n in [*range(1, 40), 500, 5000]:
        for letters in (b"the ing", bytes(range(256)), b"a"):
            word = bytes(r.choice(letters) for _ in range(n))
            assert byte_bpe.merged(word, ranks) == library._encode_single_piece(word)
