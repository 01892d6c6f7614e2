"""Queries by name, with their DuckDB equivalents; filled by the modules of ``lectorium.plans``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.views import BASE_TABLES, DUCK_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function from views to a DataFrame; ``sql`` may use the same views by name."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return register


def with_views(sql: str) -> str:
    """Put the views that the statement uses before it, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in DUCK_VIEWS:
            if name not in needed and name not in BASE_TABLES and re.search(rf"\b{name}\b", text):
                visit(DUCK_VIEWS[name])
                needed.append(name)

    visit(sql)
    heads = ",\n".join(f"{n} AS ({DUCK_VIEWS[n]})" for n in needed)
    body = sql.strip()
    if not heads:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{heads},\n{body[len(start):]}"
    return f"WITH {heads}\n{body}"
