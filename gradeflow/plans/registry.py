"""The queries by name, each with the same rows in DuckDB's SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixture_sql import FIXTURES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_fixtures(body: str) -> str:
    """``body`` after the CTEs of all fixtures that it mentions, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(FIXTURES[name])
                needed.append(name)

    visit(body)
    recursive = "RECURSIVE " if body.lstrip().startswith("RECURSIVE") else ""
    body = body.lstrip().removeprefix("RECURSIVE").lstrip()
    ctes = [f"{n} AS ({FIXTURES[n]})" for n in needed]
    if body.startswith("WITH "):
        return f"WITH {recursive}" + ", ".join([*ctes, body.removeprefix("WITH ")])
    return (f"WITH {recursive}" + ", ".join(ctes) + " " if ctes else "") + body


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_fixtures(sql)
        return f

    return put
