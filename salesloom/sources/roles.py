"""The business roles the queries work on, built lazily from the Parquet tables.

Each role is a projection (or one aggregation) of the given tables; a role nobody asks for
is never read, and Catalyst prunes the columns a query does not use.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2001, 11, 4)  # the reporting date of every registered query
#: Deals are planned to close so many days after they were created.
PLAN_DAYS = 120

MONEY = "decimal(12,2)"
RATE = "decimal(4,2)"


def net_amount() -> F.Column:
    """Price after discount, exact: each column is made decimal before multiplying."""
    return F.col("l_extendedprice").cast(MONEY) * (F.lit(1).cast(RATE) - F.col("l_discount").cast(RATE))


STATUS_CODE = {"Won": "F", "Lost": "P", "Open": "O"}


def has_status(*names: str) -> F.Column:
    """Deals of these statuses, tested on the stored code."""
    return F.col("status_code").isin(*[STATUS_CODE[n] for n in names])


class Roles:
    """Lazy role tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def account(self) -> DataFrame:
        place = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        return (
            self.table("customer")
            .join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("c_custkey").alias("account_id"),
                F.col("c_name").alias("account_name"),
                F.col("c_mktsegment").alias("industry"),
                F.when(F.col("c_acctbal") < 0, "Prospect").otherwise("Customer").alias("customer_type"),
                F.when(F.col("c_acctbal") < 1000, "Inactive").otherwise("Active").alias("account_status"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("province"),
            )
        )

    @cached_property
    def salesperson(self) -> DataFrame:
        """One row per seller; a very low balance stands for a blank department, a negative one for a leaver."""
        place = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        return (
            self.table("supplier")
            .join(place, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("s_suppkey").alias("person_id"),
                F.col("s_name").alias("person"),
                F.when(F.col("s_acctbal") < -500, "").otherwise(F.col("r_name")).alias("department"),
                F.when(F.col("s_acctbal") < 0, F.lit(dt.date(1999, 6, 30))).alias("quit_date"),
            )
        )

    @cached_property
    def deal_core(self) -> DataFrame:
        """Deals straight from ``orders``: no join, so status and value questions stay one scan."""
        created = F.col("o_orderdate").cast("date")
        return self.table("orders").select(
            F.col("o_orderkey").alias("deal_id"),
            F.col("o_custkey").alias("account_id"),
            F.concat(F.lit("Deal "), F.col("o_orderkey").cast("string")).alias("deal_name"),
            F.when(F.col("o_orderstatus") == "F", "Won")
            .when(F.col("o_orderstatus") == "P", "Lost")
            .otherwise("Open")
            .alias("status"),
            F.col("o_orderstatus").alias("status_code"),  # as stored: a filter on it reaches the scan
            F.col("o_orderdate").alias("created_at"),
            (F.lit(110) - 20 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("possibility"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_totalprice").cast(MONEY).alias("plan_amount"),
            created.alias("created"),
            F.date_add(created, PLAN_DAYS).alias("est_close"),
            F.datediff(F.lit(AS_OF), created).alias("aging_days"),
        )

    @cached_property
    def deal_owner(self) -> DataFrame:
        """deal -> seller and part: one partial-aggregated pass over the lines."""
        return (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("deal_id"))
            .agg(F.min("l_suppkey").alias("person_id"), F.min("l_partkey").alias("part_id"))
        )

    @cached_property
    def deal(self) -> DataFrame:
        """Deals with seller and solution; a deal without lines has neither."""
        part = self.table("part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("solution"))
        person = self.table("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("person"))
        return (
            self.deal_core.join(self.deal_owner, "deal_id", "left")
            .join(part, "part_id", "left")
            .join(person, "person_id", "left")
            .drop("part_id")
        )

    @cached_property
    def actual(self) -> DataFrame:
        """Realised sales: one row per line, dated by shipment."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("deal_id"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("person_id"),
            F.col("l_shipdate").cast("date").alias("actual_date"),
            F.col("l_shipdate").alias("actual_at"),
            net_amount().alias("amount"),
        )

    @cached_property
    def target(self) -> DataFrame:
        """Monthly target per seller: gross value by the month the deal was created."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.trunc(F.col("o_orderdate"), "month").alias("target_month"),
        )
        return (
            self.table("lineitem")
            .join(orders, "l_orderkey")
            .groupBy("target_month", F.col("l_suppkey").alias("person_id"))
            .agg(F.sum(F.col("l_extendedprice").cast(MONEY)).alias("target_amount"))
        )

    @cached_property
    def activity(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("activity_id"),
            F.col("user_id").alias("deal_id"),
            F.col("event_type").alias("activity_type"),
            F.col("ts"),
            F.col("ts").cast("date").alias("activity_date"),
            F.col("ts").alias("activity_at"),
            F.col("value").cast(MONEY).alias("value"),
            F.col("props"),
        )

    @cached_property
    def contact(self) -> DataFrame:
        """Contacts: the turns of a conversation are the people known at one account."""
        ident = F.format_string("%d-%d", F.col("conv_id"), F.col("turn"))
        return self.table("conversations").select(
            ident.alias("contact_id"),
            F.col("conv_id").alias("account_id"),
            F.concat(F.lit("Contact "), ident).alias("contact_name"),
            F.col("role").alias("job_title"),
        )

    @cached_property
    def note(self) -> DataFrame:
        return self.table("pages").select(
            F.col("page_id").alias("note_id"),
            F.col("page_id").alias("account_id"),
            F.col("url").alias("title"),
            F.col("html").alias("body"),
        )

    @cached_property
    def income(self) -> DataFrame:
        """Income plan: lines with the seller's department and the names the rules look at."""
        part = self.table("part").select(
            F.col("p_partkey").alias("part_id"), F.col("p_name").alias("deal_label"), F.col("p_type").alias("solution")
        )
        person = self.salesperson.select("person_id", "department")
        return (
            self.actual.join(part, "part_id", "left")
            .join(person, "person_id", "left")
            .select("department", "deal_label", "solution", "amount", F.col("actual_date").alias("day"), F.col("actual_at").alias("at"))
        )

    @cached_property
    def expense(self) -> DataFrame:
        """Project expenses: tax of a line; the project code is blank on returned-flag N."""
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("deal_label"), F.col("p_brand")
        )
        person = self.salesperson.select(F.col("person_id").alias("l_suppkey"), "department")
        return (
            self.table("lineitem")
            .join(part, "l_partkey", "left")
            .join(person, "l_suppkey", "left")
            .select(
                "department",
                "deal_label",
                F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("p_brand")).alias("project_code"),
                (F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast(RATE)).alias("amount"),
                F.col("l_shipdate").cast("date").alias("day"),
                F.col("l_shipdate").alias("at"),
            )
        )

    @cached_property
    def employee_cost(self) -> DataFrame:
        person = self.salesperson.select("person_id", "department", "quit_date")
        return (
            self.table("lineitem")
            .select(
                F.col("l_suppkey").alias("person_id"),
                F.col("l_shipdate").cast("date").alias("day"),
                F.col("l_shipdate").alias("at"),
                F.col("l_quantity").cast(MONEY).alias("cost"),
            )
            .join(person, "person_id", "left")
        )

    @cached_property
    def allocation(self) -> DataFrame:
        """Staff allocations: a type and a percentage over a span of days."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate"))
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type"))
        first, last = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
        return (
            self.table("lineitem")
            .join(orders, "l_orderkey")
            .join(part, "l_partkey")
            .select(
                F.col("l_suppkey").alias("person_id"),
                F.col("p_type").alias("allocate_type"),
                (F.col("l_discount").cast(RATE) * 100).cast("int").alias("assign_percent"),
                F.least(first, last).alias("start_date"),
                F.greatest(first, last).alias("finish_date"),
            )
        )
