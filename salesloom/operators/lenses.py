"""The same deals regrouped per solution, per salesperson and per industry.

``deals`` is flat: ``deal_id, account_name, deal_name, status, possibility, est_close,
person, solution`` and, where known, ``description`` and ``detail_reasons``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.text import slugify, strip_html
from salesloom.operators.nest import BLOCK_SIZE, collected, grouped_items
from salesloom.operators.rank import recent_n


def _text(deals: DataFrame, name: str):
    return strip_html(F.col(name)) if name in deals.columns else F.lit("")


def _nonblank(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.trim(F.col(col))).where(F.col(col) != "")


def solution_rows(deals: DataFrame) -> tuple[DataFrame, Column, list[Column]]:
    """Deals with a solution, what is shown of one, and the figures of a solution; an empty account name is not an account."""
    item = F.struct(
        F.col("account_name"),
        F.col("deal_name"),
        F.col("status"),
        F.col("possibility"),
        F.col("est_close"),
        F.col("person"),
        _text(deals, "description").alias("description"),
        _text(deals, "detail_reasons").alias("detail_reasons"),
    )
    stats = [
        F.count(F.lit(1)).alias("deal_count"),
        F.countDistinct(F.nullif("account_name", F.lit(""))).alias("account_count"),
    ]
    return _nonblank(deals, "solution"), item, stats


def lens_solution(deals: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Per solution: deals, deal count, distinct accounts."""
    rows, item, stats = solution_rows(deals)
    grouped = grouped_items(rows, "solution", "deal_id", item, stats, block_size)
    return grouped.withColumnRenamed("items", "deals").withColumn("key", slugify(F.col("solution")))


def salesperson_rows(deals: DataFrame) -> tuple[DataFrame, Column, list[Column]]:
    """Deals with a seller, what is shown of one, and the figures of a seller; an empty account name counts once."""
    item = F.struct(
        F.col("account_name"),
        F.col("deal_name"),
        F.col("status"),
        F.col("solution"),
        F.col("est_close"),
        _text(deals, "description").alias("description"),
    )
    stats = [
        F.count(F.lit(1)).alias("deal_count"),
        F.countDistinct(F.coalesce("account_name", F.lit(""))).alias("account_count"),
    ]
    return _nonblank(deals, "person"), item, stats


def seller_activities(owned: DataFrame, activities: DataFrame, recent: int | None = None) -> tuple[DataFrame, list[Column], Column]:
    """The activities on a seller's deals (the ``recent`` latest of them), their order and what is shown of one."""
    shown = activities.join(owned.select("deal_id", "person"), "deal_id")
    if recent is not None:
        shown = recent_n(shown, "person", [F.col("activity_date").desc(), F.col("activity_id")], recent)
    age = F.coalesce(-F.unix_micros(F.try_to_timestamp(F.col("activity_date").cast("string"))), F.lit(2**63 - 1))
    return shown, [age.alias("age"), F.col("activity_id")], F.struct("activity_date", "subject", "activity_type", "state")


def lens_salesperson(
    deals: DataFrame, activities: DataFrame, recent: int | None = None, block_size: int = BLOCK_SIZE
) -> DataFrame:
    """Per salesperson: deals, accounts and the activities, the latest first; with ``recent`` only so many of them.

    ``activities``: ``activity_id, deal_id, activity_date, subject, activity_type, state``.
    """
    owned, item, stats = salesperson_rows(deals)
    grouped = grouped_items(owned, "person", "deal_id", item, stats, block_size).withColumnRenamed("items", "deals")
    shown, order, row = seller_activities(owned, activities, recent)
    entry = F.struct(*order, row.alias("row"))
    lists = collected(shown.select("person", entry.alias("activities")), "person", ["activities"], block_size)
    return (
        grouped.join(lists.select("person", F.transform("activities", lambda a: a["row"]).alias("activities")), "person", "left")
        .withColumn("activities", F.coalesce("activities", F.array()))
        .withColumn("key", slugify(F.col("person")))
    )


def industry_rows(accounts: DataFrame, deals: DataFrame) -> tuple[DataFrame, Column, list[Column]]:
    """Accounts with an industry, what is shown of one with its deal count and sorted solutions, and the figures of an industry."""
    per_account = deals.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("opp_count"),
        F.array_sort(F.collect_set(F.when(F.trim("solution") != "", F.col("solution")))).alias("solutions"),
    )
    joined = (
        _nonblank(accounts, "industry")
        .join(per_account, "account_id", "left")
        .withColumn("opp_count", F.coalesce("opp_count", F.lit(0).cast("bigint")))
        .withColumn("solutions", F.coalesce("solutions", F.array().cast("array<string>")))
    )
    place = F.filter(F.array("city", "province"), lambda x: x.isNotNull() & (x != ""))
    item = F.struct(
        F.col("account_name"),
        F.col("customer_type"),
        F.col("account_status"),
        F.array_join(place, ", ").alias("location"),
        F.col("opp_count"),
        F.col("solutions"),
    )
    return joined, item, [F.count(F.lit(1)).alias("account_count")]


def lens_industry(accounts: DataFrame, deals: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Per industry: its accounts with place, deal count and sorted distinct solutions."""
    rows, item, stats = industry_rows(accounts, deals)
    grouped = grouped_items(rows, "industry", "account_id", item, stats, block_size)
    return grouped.withColumnRenamed("items", "accounts").withColumn("key", slugify(F.col("industry")))
