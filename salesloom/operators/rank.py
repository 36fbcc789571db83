"""Top-n, latest-n and result listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.values import format_value


def topn(df: DataFrame, by: str, n: int, ties: bool = True) -> DataFrame:
    """The n highest rows; ties with the n-th row stay in unless told otherwise.

    The threshold is the lowest value of a distributed top-n (one number), and the ties are
    a plain filter against it, so they are never gathered in one task.
    """
    if not ties:
        return df.where(F.col(by).isNotNull()).orderBy(F.col(by).desc()).limit(n)
    best = df.where(F.col(by).isNotNull()).select(by).orderBy(F.col(by).desc()).limit(n)
    threshold = best.agg(F.min(by).alias(by)).scalar()
    return df.where(F.col(by) >= threshold)


def topn_per(df: DataFrame, per: Sequence[str], by: str, n: int) -> DataFrame:
    """The n highest rows of each group with ties; Spark limits groups before the shuffle."""
    window = Window.partitionBy(*per).orderBy(F.col(by).desc())
    return df.withColumn("_rank", F.rank().over(window)).where(F.col("_rank") <= n).drop("_rank")


def recent_n(df: DataFrame, per: str, order: Sequence[Column], n: int = 50) -> DataFrame:
    """The first n rows of each group in a total order, with their rank."""
    window = Window.partitionBy(per).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


# A column whose name holds one of these names the account or person of a row.
SUBJECT_NAMES = ("account", "customer", "sale person", "saleperson", "sales person")
NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")


def _is_subject(name: str) -> bool:
    return any(hint in name.lower() for hint in SUBJECT_NAMES)


def measure_column(df: DataFrame) -> str | None:
    """The first numeric column that does not name an account or person."""
    for name, dtype in df.dtypes:
        if dtype.startswith(NUMERIC) and not _is_subject(name):
            return name
    return None


def top_contributors(df: DataFrame, n: int = 5, lookup: DataFrame | None = None) -> DataFrame:
    """Who stands behind a result: ``name, account_id, name_source, value, measure`` of the n largest rows.

    Without an account column the result is an aggregate: one row gives its value, several
    give none. ``lookup`` (``id, name, source``) names GUID-shaped ids.
    """
    measure = measure_column(df)
    subjects = [c for c in df.columns if _is_subject(c)]
    label = F.lit(measure).cast("string").alias("measure")
    if not subjects:
        value = F.col(f"`{measure}`").cast("double") if measure else F.lit(None).cast("double")
        single = F.when(F.count(F.lit(1)) == 1, F.max(value))
        return df.agg(single.alias("value")).select("value", label, F.lit(True).alias("is_aggregate_only"))
    rows = df.select(
        F.col(f"`{subjects[0]}`").cast("string").alias("_raw"),
        (F.col(f"`{measure}`") if measure else F.lit(None)).cast("double").alias("value"),
    )
    best = rows.where(F.col("value").isNotNull()).orderBy(F.col("value").desc(), "_raw") if measure else rows
    best = best.limit(n)
    if lookup is None:
        named = best.withColumn("_name", F.lit(None).cast("string")).withColumn("name_source", F.lit(None).cast("string"))
    else:
        from salesloom.functions.values import is_guid

        known = lookup.select(F.upper("id").alias("_key"), F.col("name").alias("_name"), F.col("source").alias("name_source"))
        named = best.join(known, (F.upper("_raw") == F.col("_key")) & is_guid(F.col("_raw")), "left")
    return named.select(
        F.coalesce("_name", "_raw").alias("name"),
        F.when(F.col("_name").isNotNull(), F.col("_raw")).alias("account_id"),
        "name_source",
        "value",
        label,
        F.lit(False).alias("is_aggregate_only"),
    )


def row_cap(df: DataFrame, order: Sequence[Column], n: int = 50) -> DataFrame:
    """The listing shown to a reader: its first n rows, each with the total behind it."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).limit(n).withColumn("shown", F.least(F.lit(n).cast("bigint"), total)).withColumn("total", total)


def md_row_table(df: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    """Result rows as one Markdown table: header, rule, at most n lines, a note when there are more."""
    names = df.columns
    cells = [format_value(name, F.col(f"`{name}`"), dtype) for name, dtype in df.dtypes]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rank = F.row_number().over(Window.orderBy(*order))
    shown = df.orderBy(*order).limit(n).select(rank.alias("_rank"), line.alias("_line"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    head = "| " + " | ".join(names) + " |\n| " + " | ".join("---" for _ in names) + " |"
    note = F.when(total > n, F.concat(F.lit(f"\n\n_(showing {n} of "), total.cast("string"), F.lit(" rows)_"))).otherwise("")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_line"))), lambda x: x["_line"]), "\n")
    return shown.agg(lines.alias("_lines")).select(
        F.when(total > 0, F.concat(F.lit(head + "\n"), F.col("_lines"), note)).otherwise("").alias("markdown")
    )
