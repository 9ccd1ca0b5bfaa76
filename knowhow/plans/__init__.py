"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib

FAMILIES = ["views", "search", "ingest", "people", "themes", "clusters", "profiles", "evaluation"]


def _load():
    for name in FAMILIES:
        importlib.import_module(f"knowhow.plans.{name}")


def all_queries() -> dict:
    from knowhow.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from knowhow.plans.registry import SQL, full_sql

    _load()
    return {name: full_sql(sql) for name, sql in SQL.items()}
