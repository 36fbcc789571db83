"""Write only what changed: outcomes, reports and merged tables by key and content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _no_key(keys: Sequence[str]) -> Column:
    empty = F.lit(False)
    for key in keys:
        empty = empty | (F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "")
    return empty


def upsert_outcome(current: DataFrame, new: DataFrame, keys: Sequence[str], hash_col: str = "md_hash") -> DataFrame:
    """Each new row with ``outcome``: uploaded (new or changed), skipped (same hash) or errors (no key)."""
    stored = current.select(*keys, F.col(hash_col).alias("_stored"))
    return (
        new.join(stored, list(keys), "left")
        .withColumn(
            "outcome",
            F.when(_no_key(keys), "errors")
            .when(F.col("_stored").eqNullSafe(F.col(hash_col)), "skipped")
            .otherwise("uploaded"),
        )
        .drop("_stored")
    )


def changed_only(current: DataFrame, new: DataFrame, keys: Sequence[str], hash_col: str = "md_hash") -> DataFrame:
    """New rows whose (key, hash) is not stored."""
    return new.where(~_no_key(keys)).join(current.select(*keys, hash_col), [*keys, hash_col], "left_anti")


def upsert_report(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``uploaded / skipped / errors`` in total or per group."""
    return outcomes.groupBy(*by).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("uploaded", "skipped", "errors")]
    )


def upsert_actions(
    current: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    hash_col: str = "md_hash",
    stale_within: str | None = None,
) -> DataFrame:
    """Per key what a merge does: insert, update, keep, or delete.

    Rows only the stored side has are kept. With ``stale_within`` (a column of the key) they
    are deleted where that column's value was written anew: the trailing chunks of a document
    that became shorter.
    """
    a = current.select(*keys, F.col(hash_col).alias("old_hash"), F.lit(True).alias("_old"))
    b = new.select(*keys, F.col(hash_col).alias("new_hash"), F.lit(True).alias("_new"))
    both = a.join(b, list(keys), "full_outer")
    gone = F.lit("keep")
    if stale_within:
        rewritten = new.select(stale_within).distinct().withColumn("_rewritten", F.lit(True))
        both = both.join(rewritten, stale_within, "left")
        gone = F.when(F.col("_rewritten"), "delete").otherwise("keep")
    return both.withColumn(
        "action",
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), gone)
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "keep")
        .otherwise("update"),
    ).select(*keys, "old_hash", "new_hash", "action")


def merge_rows(
    current: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    hash_col: str = "md_hash",
    stale_within: str | None = None,
) -> DataFrame:
    """The table after the merge: stored rows that stay, new rows that changed, in one outer join."""
    columns = [c for c in new.columns if c not in keys]
    a = current.select(*keys, F.struct(*columns).alias("_a"))
    b = new.where(~_no_key(keys)).select(*keys, F.struct(*columns).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    if stale_within:
        rewritten = new.select(stale_within).distinct().withColumn("_rewritten", F.lit(True))
        both = both.join(rewritten, stale_within, "left").where(
            F.col("_b").isNotNull() | F.col("_rewritten").isNull()
        )
    same = F.col(f"_a.{hash_col}").eqNullSafe(F.col(f"_b.{hash_col}"))
    kept = F.when(F.col("_b").isNull() | (F.col("_a").isNotNull() & same), F.col("_a")).otherwise(F.col("_b"))
    return both.withColumn("_row", kept).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def uniqueness_check(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with how often; empty when the key is unique."""
    return df.groupBy(*pk).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
