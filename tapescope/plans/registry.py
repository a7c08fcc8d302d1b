"""Registry of named queries and, where one exists, the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named sub-query the check SQL may refer to."""
    VIEWS[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def _plain_counts(sql: str) -> str:
    """count_if(x) as a filtered count, whose result is a BIGINT like Spark's."""
    out, i = [], 0
    for m in re.finditer(r"count_if\(", sql):
        if m.start() < i:
            continue
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += [sql[i:m.start()], "count(*) FILTER (WHERE ", sql[m.end():j]]
        i = j
    return "".join(out) + sql[i:]


def with_views(sql: str) -> str:
    """Put the views ``sql`` refers to (and theirs) in front as CTEs."""
    return _plain_counts(_with_views(sql))


def _with_views(sql: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _needs(VIEWS[name]):
            if dep != name:
                visit(dep)
        ordered.append(name)

    for name in _needs(sql):
        visit(name)
    body = sql.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in ordered)
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH"):
        body = re.sub(r"(?i)^WITH\s+(RECURSIVE\s+)?", "", body)
        return f"WITH {recursive}{head},\n{body}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` together with its check SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
