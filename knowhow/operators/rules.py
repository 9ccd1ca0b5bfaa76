"""Data-quality rules. Every rule returns (row_key, severity, rule, detail); severity is problem or note."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowhow import constants as K

# Patterns per value kind.
CODE_PATTERN = {t: f"^{p}[0-9]{{4}}-[0-9]{{4}}$" for t, p in K.DOC_PREFIX.items()}
EMP_NO_PATTERN = "^[0-9]{4,5}$"
ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
LOCAL_DATE = "^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日$"
# Section name -> role, per document type, and whether the section must be there (fixed values, in our codes).
SECTION_ROLES = {
    "proposal": {"current_state": "background", "issue": "problem", "proposal": "action_plan",
                 "expected_effect": "goal", "obstacle": "obstacle"},
    "project": {"background": "background", "purpose": "purpose", "work": "action", "outcome": "outcome"},
}
REQUIRED_SECTIONS = {"proposal": ["current_state", "issue", "proposal", "expected_effect"],
                     "project": ["background", "purpose", "work"]}
REQUIRED = {"proposal": ["submitted_at", "proposal_area", "result"],
            "project": ["pj_status", "started_at", "planned_end_at", "owner_dept", "updated_at"],
            "idea": ["submitted_at"]}


def _issue(df: DataFrame, key, severity: str, rule: str, detail) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(
        key.cast("string").alias("row_key"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
        detail.alias("detail"),
    )


def _blank(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c) == "", F.lit(True))


def union(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def _one_per_item(df, key, items: list[tuple[str, Column]], severity, rule):
    """One issue row for every item whose condition holds (single pass over the rows)."""
    found = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in items]), lambda x: x.isNotNull()
    )
    return _issue(df.withColumn("_item", F.explode(found)), key, severity, rule, F.col("_item"))


def required_columns(df: DataFrame, key: str, required: dict[str, list[str]], kind: str = "doc_type") -> DataFrame:
    """Columns a document type needs that are empty."""
    items = [
        (c, (F.col(kind) == t) & _blank(c)) for t, cols in required.items() for c in cols
    ]
    return _one_per_item(df, key, items, "problem", "required")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _issue(d, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), "problem", "duplicate key",
                  F.col("n").cast("string"))


def orphans(df: DataFrame, key: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Values that point to no parent; empty values are not checked."""
    p = parent.select(F.col(parent_key).alias(column)).distinct()
    bad = df.where(F.col(column).isNotNull()).join(p, column, "left_anti")
    return _issue(bad, key, "problem", f"unknown {column}", F.col(column).cast("string"))


def without_children(parents: DataFrame, key: str, children: DataFrame, rule: str = "no section") -> DataFrame:
    return _issue(parents.join(children.select(key).distinct(), key, "left_anti"), key, "problem", rule, "")


def code_pattern(df: DataFrame, key: str, code: str = "doc_code", kind: str = "doc_type") -> DataFrame:
    ok = reduce(lambda a, t: F.when(F.col(kind) == t[0], F.col(code).rlike(t[1])).otherwise(a), CODE_PATTERN.items(), F.lit(False))
    return _issue(df.where(~F.coalesce(ok, F.lit(False))), key, "problem", "code form", F.col(code))


def value_pattern(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return _issue(df.where(~F.col(column).rlike(pattern)), key, "problem", f"{column} form", F.col(column))


def iso_date(c) -> Column:
    """ISO text of a date written as ISO or as year, month and day marks; null when it is neither or no real day."""
    c = F.col(c) if isinstance(c, str) else c
    y, m, d = (F.regexp_extract(c, LOCAL_DATE, i) for i in (1, 2, 3))
    text = F.when(c.rlike(LOCAL_DATE), F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))).when(
        c.rlike(ISO_DATE), c
    )
    return F.when(F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def date_form(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    items = [(c, F.col(c).isNotNull() & ~F.col(c).rlike(ISO_DATE)) for c in columns]
    return _one_per_item(df, key, items, "problem", "date form")


def allowed_values(df: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    items = [(c, ~_blank(c) & ~F.col(c).isin(*vals)) for c, vals in allowed.items()]
    return _one_per_item(df, key, items, "problem", "value")


def max_length(df: DataFrame, key: str, limits: dict[str, int]) -> DataFrame:
    items = [(c, F.length(F.trim(c)) > n) for c, n in limits.items()]
    return _one_per_item(df, key, items, "problem", "too long")


def cross_field(df: DataFrame, key: str) -> DataFrame:
    """A pending decision has no date, finished projects have an end, unfinished ones have none."""
    has_end = ~_blank("ended_at")
    items = [
        ("in review but decided", (F.col("result") == "in_review") & ~_blank("decided_at")),
        ("finished without end", F.col("pj_status").isin("done", "cancelled") & ~has_end),
        ("unfinished with end", F.col("pj_status").isin("planned", "running") & has_end),
    ]
    return _one_per_item(df, key, items, "problem", "consistency")


def type_agreement(df: DataFrame, key: str) -> DataFrame:
    """Type, category and code prefix belong together; each type has its own filled and empty columns."""
    match = F.lit(False)
    for t, cat in K.DOC_CATEGORY.items():
        match = match | (
            (F.col("doc_type") == t) & (F.col("doc_category") == cat) & F.col("doc_code").startswith(K.DOC_PREFIX[t])
        )
    project = ["pj_status", "started_at", "planned_end_at", "owner_dept_id", "updated_at"]
    proposal = ["submitted_at", "proposal_area", "result"]
    decision = ["decided_at", "result_reason"]
    filled = {"proposal": proposal, "project": project, "idea": ["submitted_at"]}
    empty = {"proposal": project + ["ended_at"], "project": proposal + decision,
             "idea": project + decision + ["ended_at", "result"]}
    items = [("type, category and prefix", ~match)]
    for t in filled:
        bad = [F.col(c).isNull() for c in filled[t]] + [F.col(c).isNotNull() for c in empty[t]]
        items.append((f"columns of {t}", (F.col("doc_type") == t) & reduce(lambda a, b: a | b, bad)))
    return _one_per_item(df, key, items, "problem", "type")


def author_rules(authors: DataFrame, documents: DataFrame, employees: DataFrame, departments: DataFrame, key: str) -> DataFrame:
    """Role of the wrong type, unknown employee or department; a different name is only a note."""
    a = authors.join(documents.select(key, "doc_type"), key)
    roles = F.lit(False)
    for t, rs in K.AUTHOR_ROLES.items():
        roles = roles | ((F.col("doc_type") == t) & F.col("role").isin(*rs))
    role = _issue(a.where(~roles), key, "problem", "author", "role")
    # Several employees may bear one number: that is no second problem of the author, but a note for every other name.
    k = authors.join(employees.select("emp_no", F.lit(True).alias("emp_known")).distinct(), "emp_no", "left")
    k = k.join(departments.select("dept_code", F.lit(True).alias("dept_known")).distinct(), "dept_code", "left")
    unknown = _one_per_item(k, key, [
        ("employee", F.col("emp_no").isNotNull() & F.col("emp_known").isNull()),
        ("department", F.col("dept_code").isNotNull() & F.col("dept_known").isNull()),
    ], "problem", "author")
    named = authors.join(employees.select("emp_no", F.col("name").alias("known_name")), "emp_no")
    notes = _issue(named.where(F.col("known_name") != F.col("name")), key, "note", "author name", F.col("emp_no"))
    return union(role, unknown, notes)


def repeated_person(authors: DataFrame, key: str, person: str = "emp_no") -> DataFrame:
    d = authors.groupBy(key, person).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _issue(d, key, "problem", "person twice", F.col(person).cast("string"))


def role_counts(documents: DataFrame, authors: DataFrame, key: str) -> DataFrame:
    """A proposal has one proposer; a project one owner and one lead."""
    def n(role):
        return F.count(F.when(F.col("role") == role, 1))

    counts = authors.groupBy(key).agg(n("proposer").alias("p"), n("owner").alias("o"), n("lead").alias("l"))
    d = documents.select(key, "doc_type").join(counts, key, "left").na.fill(0, ["p", "o", "l"])
    return _one_per_item(d, key, [
        ("one proposer", (F.col("doc_type") == "proposal") & (F.col("p") != 1)),
        ("one owner", (F.col("doc_type") == "project") & (F.col("o") != 1)),
        ("one lead", (F.col("doc_type") == "project") & (F.col("l") != 1)),
    ], "problem", "role count")


def section_role(kind="doc_type", name="section_name") -> Column:
    c = F.lit(None).cast("string")
    for t, roles in SECTION_ROLES.items():
        for section, role in roles.items():
            c = F.when((F.col(kind) == t) & (F.col(name) == section), role).otherwise(c)
    return c


def section_rules(sections: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Unknown section name, over-long name, empty or over-long body; documents without any section."""
    d = documents.select(key, "doc_type").where(F.col("doc_type").isin(*SECTION_ROLES))
    s = sections.join(d, key)
    issues = _one_per_item(s, key, [
        ("unknown section", section_role().isNull()),
        ("name too long", F.length("section_name") > K.MAX_SECTION_NAME),
        ("empty body", _blank("body")),
        ("body too long", F.length(F.trim("body")) > K.MAX_BODY),
    ], "problem", "section")
    return union(issues, without_children(d, key, sections))


def section_completeness(documents: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Missing required sections, outcome expected of finished projects, sections twice, very short bodies."""
    d = documents.select(key, "doc_type", "pj_status").where(F.col("doc_type").isin(*SECTION_ROLES))
    wanted = sorted({s for required in REQUIRED_SECTIONS.values() for s in required} | {"outcome"})
    has = sections.groupBy(key).agg(*[F.max(F.col("section_name") == s).alias(f"has_{s}") for s in wanted])
    d = d.join(has, key, "left").na.fill(False, [f"has_{s}" for s in wanted])
    items = [
        (f"missing {s}", (F.col("doc_type") == t) & ~F.col(f"has_{s}"))
        for t, required in REQUIRED_SECTIONS.items() for s in required
    ]
    finished = F.coalesce(F.col("pj_status").isin("done", "cancelled"), F.lit(False))
    has_outcome = F.col("has_outcome")
    items.append(("missing outcome", (F.col("doc_type") == "project") & finished & ~has_outcome))
    problems = _one_per_item(d, key, items, "problem", "sections")
    early = _issue(
        d.where((F.col("doc_type") == "project") & F.col("pj_status").isin("planned", "running") & has_outcome),
        key, "note", "sections", "outcome before the end",
    )
    known = sections.join(d.select(key), key, "left_semi")
    twice = known.groupBy(key, "section_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    short = known.where(~_blank("body") & (F.length(F.trim("body")) < K.SHORT_BODY))
    return union(
        problems, early, _issue(twice, key, "problem", "section twice", F.col("section_name")),
        _issue(short, key, "note", "short section", F.col("section_name")),
    )


def is_skipped_file(name="file_name") -> Column:
    """Temporary copies and files of another kind take no part in a batch."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(name.startswith("~$") | ~F.lower(name).endswith(".docx"), F.lit(True))


def batch_codes(batch: DataFrame, existing: DataFrame, key: str, code: str = "doc_code") -> DataFrame:
    """A code used by several files stops all of them; a code already stored is noted as an overwrite."""
    n = batch.groupBy(code).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(code)
    twice = _issue(batch.join(n, code, "left_semi"), key, "problem", "code in several files", F.col(code))
    over = _issue(batch.join(existing.select(code), code, "left_semi"), key, "note", "overwrite", F.col(code))
    return union(twice, over)


def batch_issues(documents: DataFrame, authors: DataFrame, sections: DataFrame, employees: DataFrame, departments: DataFrame,
                 existing: DataFrame, allowed: dict[str, list[str]], key: str = "file_id") -> DataFrame:
    """Every rule that looks at a batch of files, over the files that are not skipped."""
    files = documents.where(~is_skipped_file())
    authors, sections = (df.join(files.select(key), key, "left_semi") for df in (authors, sections))
    dated = files.withColumn("submitted_at", F.coalesce(iso_date("submitted_at"), "submitted_at"))
    return union(
        required_columns(files, key, REQUIRED), code_pattern(files, key), value_pattern(authors, key, "emp_no", EMP_NO_PATTERN),
        orphans(files, key, "owner_dept", departments, "dept_code"), date_form(dated, key, ["submitted_at"]),
        allowed_values(files, key, allowed),
        max_length(files, key, {"title": K.MAX_TITLE, "source_file": K.MAX_SOURCE_FILE, "result_reason": K.MAX_REASON}),
        cross_field(files, key), author_rules(authors, files, employees, departments, key), repeated_person(authors, key),
        role_counts(files, authors, key), section_rules(sections, files, key), section_completeness(files, sections, key),
        batch_codes(files, existing, key),
    )


def note_consistency(notes: DataFrame, key: str = "note_id") -> DataFrame:
    """No document exactly for self-written notes; a model exactly for summaries; an item kind exactly for own notes."""
    own = F.col("body_source") == "self"
    return _one_per_item(notes, key, [
        ("document", F.col("doc_id").isNull() != own),
        ("model", (F.col("body_source") == "summary") != F.col("model").isNotNull()),
        ("kind", F.col("memo_kind").isNotNull() != own),
    ], "problem", "note")


def career_sheet_rules(sheets: DataFrame, employees: DataFrame, items: list[str], max_chars: int = K.MEMO_CHARS) -> DataFrame:
    """Unknown or repeated employee (first sheet stands), over-long item, nothing filled in."""
    s = sheets.withColumn("emp_no", F.trim("emp_no"))
    known = s.join(employees.select("emp_no"), "emp_no", "left_semi")
    unknown = _issue(s.join(employees.select("emp_no"), "emp_no", "left_anti"), "conv_id", "problem", "unknown employee", F.col("emp_no"))
    known = known.join(known.groupBy("emp_no").agg(F.min("conv_id").alias("first_sheet")), "emp_no")
    again = _issue(known.where("conv_id > first_sheet"), "conv_id", "problem", "repeated employee", F.col("emp_no"))
    first = known.where("conv_id = first_sheet")
    long = _one_per_item(first, "conv_id", [(c, F.length(F.trim(c)) > max_chars) for c in items], "problem", "item too long")
    none = reduce(lambda a, b: a & b, [_blank(c) | (F.length(F.trim(c)) > max_chars) for c in items])
    return union(unknown, again, long, _issue(first.where(none), "conv_id", "problem", "all items empty", F.col("emp_no")))


def length_summary(texts: DataFrame, column: str) -> DataFrame:
    """Upper median and maximum length."""
    n = texts.select(F.length(F.trim(column)).alias("len"))
    return n.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY len DESC)").cast("long").alias("median_len"),
        F.max("len").cast("long").alias("max_len"),
    )


def verdicts(files: DataFrame, issues: DataFrame, key: str = "file_id", name: str = "file_name") -> DataFrame:
    """loadable / loadable with notes / rejected / skipped per file."""
    worst = issues.groupBy(F.col("row_key").alias("_k")).agg(
        F.max(F.col("severity") == "problem").alias("problem"), F.max(F.col("severity") == "note").alias("note")
    )
    f = files.withColumn("_k", F.col(key).cast("string")).join(worst, "_k", "left")
    skipped = is_skipped_file(name)
    verdict = (
        F.when(skipped, "skipped").when(F.col("problem"), "rejected").when(F.col("note"), "loadable with notes")
        .otherwise("loadable")
    )
    return f.select(key, name, verdict.alias("verdict"))


def single_model(sections: DataFrame, query_model: str, column: str = "embedding_model") -> DataFrame:
    return sections.where(F.col(column).isNotNull()).agg(
        F.count_distinct(column).alias("models"), F.min(column).alias("model"),
    ).withColumn("consistent", (F.col("models") == 1) & (F.col("model") == query_model))
