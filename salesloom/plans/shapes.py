"""Output columns in types both engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(col: Column | str, name: str) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return F.round(value, 2).cast("double").alias(name)


def rate(col: Column | str, name: str) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return F.round(value.cast("double"), 6).alias(name)


def whole(col: Column | str, name: str) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return value.cast("bigint").alias(name)


def sql_money(expr: str, name: str) -> str:
    return f"CAST(round({expr}, 2) AS DOUBLE) AS {name}"


def sql_rate(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"
