"""The register of named queries and of the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salesloom.plans.role_sql import ROLE_SQL
from salesloom.sources.roles import Roles

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **ctes: str):
    """Register ``fn(roles) -> DataFrame`` under ``name``, with its check SQL if SQL can say it."""

    def add(fn: Callable[[Roles], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Roles(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_roles(sql, ctes)
        return fn

    return add


def with_roles(sql: str, ctes: dict[str, str] | None = None) -> str:
    """Put the role views a statement mentions (and those they mention) in a WITH clause."""
    known = {**ROLE_SQL, **(ctes or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS (\n{known[name]}\n)" for name in dict.fromkeys(needed))
    return f"WITH {views}\n{sql}"
