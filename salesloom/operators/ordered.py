"""Ordered computations that hold up when one key owns much of the table.

A window over such a key would sort all its rows in one task. Here the rows of a key are
cut by a ``bucket`` column that never decreases along the order (a day, a range of ids):

1. aggregate each (key, bucket) to one row, partially before the shuffle;
2. run the window over those few rows per key;
3. join the result back on (key, bucket) and finish inside the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.session import materialize


def previous_value(
    df: DataFrame, key: str, order: Sequence[str], value: str, bucket: Column, out: str = "previous"
) -> DataFrame:
    """The value of the row before, per key, along ``order`` (a total order)."""
    rows = df.withColumn("_bucket", bucket)
    last = rows.groupBy(key, "_bucket").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.select(
        key, "_bucket", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")).alias("_carried")
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (
        rows.join(carried, [key, "_bucket"])
        .withColumn("_rn", F.row_number().over(inside))
        .withColumn(
            out,
            F.when(F.col("_rn") == 1, F.col(f"_carried.{value}")).otherwise(F.lag(value).over(inside)),
        )
        .drop("_rn", "_bucket", "_carried")
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_index") -> DataFrame:
    """Position of each row from 0 along ``order`` inside its group, for keys and orders of any type.

    The rows are range-partitioned by sampled bounds and written once, each with its number in its
    partition. Where a partition begins inside a group is known from the counts of the partitions
    before it, a list as short as there are partitions; no group is sorted in one task. Rows alike in
    keys and order are numbered as they lie.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftrightunsigned("_id", 33))
    runs = placed.groupBy(*keys, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    if keys:
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = runs.select(*keys, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        joined = F.expr(" AND ".join([f"rows.`{k}` <=> starts.`{k}`" for k in keys] + ["rows._part = starts._part"]))
        placed = placed.alias("rows").join(starts.alias("starts"), joined).select("rows.*", "starts._first", "starts._start")
    else:
        total, listed = 0, []
        for run in sorted(runs.collect()):  # one row a partition
            listed.append((run["_part"], run["_first"], total))
            total += run["_n"]
        starts = df.sparkSession.createDataFrame(listed, "_part long, _first long, _start long")
        placed = placed.join(F.broadcast(starts), "_part")
    return placed.withColumn(out, F.col("_start") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_first", "_start")


def paged_scan(df: DataFrame, key: str, page_size: int = 30_000) -> DataFrame:
    """Number the pages of a table ordered by a unique key of any type."""
    return numbered(df, [], [key]).withColumn("page", F.floor(F.col("row_index") / page_size))


def one_page(df: DataFrame, key: str, page_size: int, skip: int) -> DataFrame:
    """A single page as its reader would ask for it: a distributed top-(skip + size)."""
    return df.orderBy(key).offset(skip).limit(page_size)


def running_total(df: DataFrame, period: str, values: Sequence[str], by: Sequence[str] = (), reset: Sequence[Column] = ()) -> DataFrame:
    """Running sums over periods; ``reset`` starts again (per year, say).

    The input is already one row per group and period, so a window holds a calendar, not facts.
    """
    window = Window.partitionBy(*by, *reset).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[F.sum(v).over(window).alias(f"{v}_running") for v in values])
