import os
import random
import sys

import pytest
from pyspark.sql import functions as F

from knowhow.functions import text as T
from knowhow.operators import rules as V
from knowhow.sources import loading as L

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from html_sections import sections_of  # noqa: E402


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("v")).first()["v"]


def test_terms_split_runs_at_script_changes(spark):
    got = one(spark, "型番 AB-12/x を品質保証データ3台。場合 2024 abc", T.terms("t"))
    assert [(t["term"], t["kind"]) for t in got] == [
        ("ab-12/x", "code"), ("型番", "word"), ("品質保証データ3台", "compound"), ("品質保証", "part"), ("データ", "part"), ("abc", "word"),
    ]


def test_query_terms_and_keywords(spark):
    assert one(spark, "Alpha beta alpha", T.query_terms("t")) == ["alpha", "beta"]
    df = spark.createDataFrame([(1, "beta alpha beta x x x gamma")], "id long, t string")
    got = [(r["term"], r["n"]) for r in T.keyword_counts(df, "id", "t", 2).orderBy("rank").collect()]
    assert got == [("beta", 2), ("alpha", 1)]  # one-letter terms do not count


@pytest.mark.parametrize("text,limit,want", [
    ("  a  b\nc ", 10, "a b c"), ("一文目です。二文目はとても長い。", 10, "一文目です。"), ("あ。" + "い" * 20, 10, "あ。" + "い" * 7 + "…"),
])
def test_clip(spark, text, limit, want):
    assert one(spark, text, T.clip("t", limit)) == want


def test_ngrams_numbers_sentences(spark):
    assert one(spark, "a b😀c", T.ngrams("t", 2)) == ["ab", "b😀", "😀c"]
    assert one(spark, "x", T.ngrams("t", 2)) == []
    assert sorted(one(spark, "１２件、3.5倍、12", T.numbers("t"))) == ["12", "3.5"]
    assert one(spark, "一。二！三", T.sentences("t")) == ["一。", "二！", "三"]


def issues(df):
    return {(r["row_key"], r["severity"], r["detail"]) for r in df.collect()}


def test_dates(spark):
    df = spark.createDataFrame([("2026年9月1日",), ("2026-09-10",), ("2026-13-01",), ("10/9/2026",), (None,)], "d string")
    assert [r[0] for r in df.select(V.iso_date("d")).collect()] == ["2026-09-01", "2026-09-10", None, None, None]


def test_cross_field_and_type_rules(spark):
    df = spark.createDataFrame(
        [(1, "in_review", None, "2026-01-01", None), (2, None, "done", None, None), (3, None, "planned", None, "2026-01-01"),
         (4, "accepted", None, "2026-01-01", None), (5, None, "done", None, "2026-01-01")],
        "id long, result string, pj_status string, decided_at string, ended_at string")
    assert {(k, d) for k, _, d in issues(V.cross_field(df, "id"))} == {
        ("1", "in review but decided"), ("2", "finished without end"), ("3", "unfinished with end")}


def test_codes_in_one_batch_all_stop(spark):
    batch = spark.createDataFrame([("f1", "KZ-2026-0001"), ("f2", "KZ-2026-0001"), ("f3", "KZ-2026-0002")], "f string, doc_code string")
    stored = spark.createDataFrame([("KZ-2026-0002",)], "doc_code string")
    assert {(k, s) for k, s, _ in issues(V.batch_codes(batch, stored, "f"))} == {("f1", "problem"), ("f2", "problem"), ("f3", "note")}


def test_skipped_files_are_told_by_name(spark):
    names = ["a.docx", "B.DOCX", "~$a.docx", "a.xlsx", "docx", "", None]
    df = spark.createDataFrame(list(enumerate(names)), "f long, file_name string")
    assert {r.f for r in df.where(V.is_skipped_file()).collect()} == {2, 3, 4, 5, 6}


def test_section_and_role_rules(spark):
    docs = spark.createDataFrame([(1, "proposal", None), (2, "project", "done")], "d long, doc_type string, pj_status string")
    secs = spark.createDataFrame(
        [(1, "current_state", "x" * 40), (1, "issue", "short"), (1, "proposal", "x" * 40), (1, "proposal", "x" * 40),
         (1, "expected_effect", "x" * 40), (2, "background", "x" * 40), (2, "misc", " ")], "d long, section_name string, body string")
    assert issues(V.section_completeness(docs, secs, "d")) == {
        ("1", "problem", "proposal"), ("1", "note", "issue"), ("2", "problem", "missing purpose"), ("2", "problem", "missing work"),
        ("2", "problem", "missing outcome")}
    assert issues(V.section_rules(secs, docs, "d")) == {("2", "problem", "unknown section"), ("2", "problem", "empty body")}
    auth = spark.createDataFrame([(1, "proposer", "00001"), (1, "proposer", "00002"), (2, "lead", "00003"), (2, "lead", "00003")], "d long, role string, emp_no string")
    assert issues(V.role_counts(docs, auth, "d")) == {("1", "problem", "one proposer"), ("2", "problem", "one owner"), ("2", "problem", "one lead")}
    assert issues(V.repeated_person(auth, "d")) == {("2", "problem", "00003")}


def test_notes_and_career_sheets(spark):
    notes = spark.createDataFrame(
        [(1, None, "self", None, "effort"), (2, 7, "self", None, None), (3, 7, "summary", None, None), (4, 7, "excerpt", "m", None)],
        "note_id long, doc_id long, body_source string, model string, memo_kind string")
    assert {(k, d) for k, _, d in issues(V.note_consistency(notes))} == {("2", "document"), ("2", "kind"), ("3", "model"), ("4", "model")}
    emps = spark.createDataFrame([("00001",), ("00002",)], "emp_no string")
    sheets = spark.createDataFrame(
        [("00001", 1, "ok", "x" * 1001), ("00001", 2, "again", None), ("00009", 3, "who", None), ("00002", 4, " ", None)],
        "emp_no string, conv_id long, a string, b string")
    assert {(k, d) for k, _, d in issues(V.career_sheet_rules(sheets, emps, ["a", "b"]))} == {
        ("1", "b"), ("2", "00001"), ("3", "00009"), ("4", "00002")}


def test_employees_with_one_number(spark):
    authors = spark.createDataFrame(
        [(1, "member", "00001", "A", "D1"), (1, "proposer", "00001", "A", "D9"), (9, "owner", "00003", "C", "D1")],
        "d long, role string, emp_no string, name string, dept_code string")
    docs = spark.createDataFrame([(1, "proposal")], "d long, doc_type string")
    emps = spark.createDataFrame([("00001", "A"), ("00001", "B"), ("00001", "C"), ("00002", None)], "emp_no string, name string")
    depts = spark.createDataFrame([("D1",), ("D1",)], "dept_code string")
    got = sorted(map(tuple, V.author_rules(authors, docs, emps, depts, "d").select("row_key", "severity", "detail").collect()))
    assert got == [("1", "note", "00001")] * 4 + [("1", "problem", "department"), ("1", "problem", "role"), ("9", "problem", "employee")]


def test_json_names_cleaning_and_sections(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"new": " a "}\n{"old": "b"}\n{"old": "c", "new": " "}\n')
    df = L.clean(L.read_json(spark, str(tmp_path), "new string, old string", {"new": "old"}))
    assert sorted((r["new"] or "-") for r in df.collect()) == ["-", "a", "b"]
    html = "<p>before</p><h1>One</h1><p>x</p><p>y</p><h1 id=2> Two </h1><p>z</p>"
    rows = L.split_sections(spark.createDataFrame([(1, html)], "k long, h string"), "k", "h").orderBy("section_no").collect()
    assert [(r["section_name"], r["body"]) for r in rows] == [("One", "x\ny"), ("Two", "z")]
    L.write_report(df, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == ["new"]


def test_sections_keep_all_text_below_a_heading(spark):
    html = ("<p>no</p><h1 class='a>b'>A <i>b</i> &amp; c</h1><style>p{}</style><p>x <b>bold</b> y &lt;z&gt;<br>next<p>open <a href='q'>link</a>"
            "<ul><li>one</li><li>two\n three</li></ul><!-- <p>not</p> --><table><tr><th>k</th><td>v</td></tr></table><pre>l1\nl2</pre>tail"
            "<script>var t='</p>';</script><H1>Second<p>z&nbsp;&#233;")
    rows = L.split_sections(spark.createDataFrame([(1, html), (2, None), (3, "<p>x</p>")], "k long, h string"), "k", "h").orderBy("section_no").collect()
    assert [(r["k"], r["section_no"], r["section_name"], r["body"]) for r in rows] == [
        (1, 1, "A b & c", "x bold y <z>\nnext\nopen link\none\ntwo three\nk | v\nl1\nl2\ntail"), (1, 2, "Second", "z\u00a0é")]


def test_sections_equal_those_of_a_parser(spark):
    r = random.Random(2)
    pieces = ["<p>", "</p>", "<h1>", "</h1>", "<h1 a='>'>", "<b>", "</b>", "<br>", "<br/>", "<div>", "</div>", "<td>", "</td>", "<tr>", "<a href=\"x>y\">", "text", " two words ", "\n",
              "&amp;", "&lt;p&gt;", "&#x41;", "&eacute;", "&nosuch;", "a & b", "<!-- c -->", "<pre>l1\nl2</pre>", "<style>p{}</style>", "<script>'</p>'</script>"]
    pages = ["".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(400)]
    pages += [row.html for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(300).collect()]
    df = spark.createDataFrame(list(enumerate(pages)), "k long, h string")
    got = {}
    for row in L.split_sections(df, "k", "h").orderBy("k", "section_no").collect():
        got.setdefault(row["k"], []).append((row["section_name"], row["body"]))
    wrong = [(k, p) for k, p in enumerate(pages) if got.get(k, []) != sections_of(p)]
    assert not wrong, (wrong[0][1], got.get(wrong[0][0]), sections_of(wrong[0][1]), len(wrong))


def test_entities_without_semicolon(spark):
    df = spark.createDataFrame([(1, "<h1>a&amp;&amp</h1><p>b &lt c &#65; &#66 &eacute;</p>")], "k long, h string")
    texts = [tuple(L.split_sections(df, "k", "h", closed=c).select("section_name", "body").first()) for c in (False, True)]
    assert texts == [("a&&", "b < c A B é"), ("a&&amp", "b &lt c A &#66 é")]


def test_tables_of_figures_are_dropped(spark):
    df = spark.createDataFrame([(1, "a | 12件\n3 | 4%"), (2, "name | plan\ntext | 5")], "k long, t string")
    got = {r["k"]: r["sentences"] for r in L.wordy_tables(df, "k", "t").collect()}
    assert got == {1: None, 2: "name：plan\ntext：5"}


def test_cells_keep_digits_that_are_their_place(spark):
    df = spark.createDataFrame([(1, "0 zero | 161.17 |  12\u3000 | 3 three\nname | plan")], "k long, t string")
    r = L.wordy_tables(df, "k", "t").first()
    assert (r["n_cells"], r["n_numeric"], r["sentences"]) == (6, 2, "0 zero：161.17：12：3 three\nname：plan")


def test_registration_merge(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    sec = "section_id long, doc_id long, section_no int, body string, embedding array<float>"
    stored = {
        "documents": df([(1, "old"), (2, "keep")], "doc_id long, title string"),
        "sections": df([(10, 1, 1, "a", [1.0]), (11, 1, 2, "b", [1.0]), (20, 2, 1, "c", [1.0])], sec),
        "authors": df([(1, 100), (1, 101), (2, 102)], "doc_id long, emp_id long"),
        "keywords": df([(1, "x"), (2, "y")], "doc_id long, keyword string"),
    }
    out = L.merge_registration(
        stored, df([(1, "new")], "doc_id long, title string"), df([(1, 1, "A")], "doc_id long, section_no int, body string"),
        df([(1, 101), (1, 103)], "doc_id long, emp_id long"), df([(1, "z")], "doc_id long, keyword string"))
    assert {tuple(r) for r in out["documents"].collect()} == {(1, "new"), (2, "keep")}
    assert {(r["section_id"], r["body"], r["embedding"] is None) for r in out["sections"].collect()} == {(10, "A", True), (20, "c", False)}
    assert {r["emp_id"] for r in out["affected"].collect()} == {100, 101, 103}
    c = out["counts"].first()
    assert (c["sections"], c["authors"], c["keywords"], c["removed_sections"], c["removed_authors"]) == (1, 2, 1, 1, 1)


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    once = L.upsert(a, b, ["k"])
    twice = L.upsert(once, b, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert L.latest(b.union(b.withColumn("v", F.lit("Z"))), ["k"], "v").where("k = 2").first()["v"] == "Z"
