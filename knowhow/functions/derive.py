"""Labels, dates, states and weights derived from document and department columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knowhow.constants import DEFAULT_ROLE_LEVEL, ROLE_LEVEL_WEIGHT, ROLE_WEIGHT


def doc_state() -> Column:
    return F.when(F.col("doc_type") == "proposal", F.col("result")).when(
        F.col("doc_type") == "project", F.col("pj_status")
    )


def doc_label() -> Column:
    return (
        F.when(F.col("doc_type") == "proposal", F.format_string("proposal (%s)", "result"))
        .when(F.col("doc_type") == "project", F.format_string("project (%s)", "pj_status"))
        .otherwise("idea")
    )


def doc_badge() -> Column:
    name = (
        F.when(F.col("doc_type") == "proposal", "improvement proposal")
        .when(F.col("doc_type") == "project", "project")
        .otherwise("idea post")
    )
    state = doc_state()
    return F.when(state.isNotNull(), F.concat(name, F.lit(" ("), state, F.lit(")"))).otherwise(name)


def doc_kind_note() -> Column:
    return (
        F.when(F.col("doc_type") == "proposal", "raised on site; the badge shows the decision")
        .when(F.col("doc_type") == "project", "record of work that was carried out")
        .otherwise("a difficulty and an idea; not reviewed")
    )


def note_kind() -> Column:
    return F.when(F.col("doc_type") == "project", "execution").otherwise("ambition")


def doc_date() -> Column:
    """Date for sorting and display: submitted, else started; empty when neither is set."""
    return F.coalesce(F.coalesce("submitted_at", "started_at").cast("string"), F.lit(""))


def ranking_date() -> Column:
    """Date used when ranking: by type, a project's start, otherwise the submission."""
    return F.when(F.col("doc_type") == "project", F.col("started_at")).otherwise(F.col("submitted_at"))


def is_proven() -> Column:
    return F.coalesce(
        ((F.col("doc_type") == "project") & (F.col("pj_status") == "done"))
        | ((F.col("doc_type") == "proposal") & (F.col("result") == "accepted")),
        F.lit(False),
    )


def status() -> Column:
    being_done = (F.col("doc_type") == "project") & F.col("pj_status").isin("running", "planned")
    in_review = (F.col("doc_type") == "proposal") & (F.col("result") == "in_review")
    return F.when(is_proven(), "solved").when(being_done | in_review, "open").otherwise("unsolved")


def is_skipped(results=(), pj_statuses=()) -> Column:
    """Documents left out of profiles; both lists are empty by default."""
    a = (F.col("doc_type") == "proposal") & F.col("result").isin(*results) if results else F.lit(False)
    b = (F.col("doc_type") == "project") & F.col("pj_status").isin(*pj_statuses) if pj_statuses else F.lit(False)
    return F.coalesce(a | b, F.lit(False))


def dept_site() -> Column:
    name = F.col("dept_name")
    return F.when(F.col("dept_type") == "hq", F.lit(None)).otherwise(F.split(name, " ", 2)[0])


def dept_func() -> Column:
    name = F.col("dept_name")
    whole = (F.col("dept_type") == "hq") | ~name.contains(" ")
    return F.when(whole, F.regexp_replace(name, "部$", "")).otherwise(
        F.regexp_replace(F.get(F.split(name, " ", 2), F.lit(1)), "課$", "")
    )


def role_weights(levels: dict[str, str] | None = None) -> dict[str, float]:
    """Weights from levels, with overrides on top of the default level per role."""
    return {r: ROLE_LEVEL_WEIGHT[lv] for r, lv in {**DEFAULT_ROLE_LEVEL, **(levels or {})}.items()}


def role_weight(role, weights: dict[str, float] | None = None) -> Column:
    c = F.lit(0.0)
    for name, w in (weights or ROLE_WEIGHT).items():
        c = F.when(F.col(role) == name, F.lit(float(w))).otherwise(c)
    return c
