"""Names the registered queries and composes the SQL they are checked against."""

from __future__ import annotations

import re

QUERIES: dict = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def query(name: str, sql: str | None = None):
    def add(fn):
        from knowhow.sources.corpus import Corpus

        QUERIES[name] = lambda spark, folder: fn(Corpus(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _needed(sql: str, seen: list[str]) -> None:
    for name in re.findall(r"\b(?:fx|v|in)_\w+\b", sql):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)


def full_sql(sql: str) -> str:
    """Prefix a statement with the common table expressions it uses."""
    names: list[str] = []
    _needed(sql, names)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return "WITH RECURSIVE " + ctes + ",\n" + re.sub(r"(?i)^with\s+recursive\s", "", body)
    if re.match(r"(?i)with\b", body):
        return "WITH " + ctes + ",\n" + re.sub(r"(?i)^with\s", "", body)
    return "WITH " + ctes + "\n" + body
