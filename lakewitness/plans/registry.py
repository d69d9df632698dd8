"""Named queries and the SQL another engine can check them with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakewitness.plans.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Named sub-statements the check SQL is put together from.
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def compose(sql: str) -> str:
    """Put the named parts a statement mentions, and those they mention, in front of it."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", text):
            if name in PARTS and name not in seen:
                seen.add(name)
                visit(PARTS[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    recursive = "RECURSIVE " if any("RECURSION" in PARTS[n] for n in order) else ""
    body = ",\n".join(f"{n} AS MATERIALIZED (\n{PARTS[n]}\n)" if "RECURSION" not in PARTS[n] else f"{n} AS (\n{PARTS[n]}\n)" for n in order)
    return f"WITH {recursive}{body}\n{sql.strip()}"


def query(name: str, sql: str | None = None):
    """Register ``fn(workspace) -> DataFrame`` under a name, with its check SQL if SQL can express it."""

    def register(fn: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(workspace(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register
