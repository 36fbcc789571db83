"""Revenue, cost and profit by department, with amounts moved between departments by rule."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.values import blank_to_null, ratio
from salesloom.operators.measures import _blank_sum, drill_across
from salesloom.session import materialize


@dataclass(frozen=True)
class Move:
    """Every row that meets ``test``, whatever its department, counts for ``to`` and is taken from ``source``."""

    test: Column
    to: str
    source: str | None = None


def _entry(department: Column | str, amount: Column) -> Column:
    name = F.lit(department) if isinstance(department, str) else department
    return F.struct(name.alias("department"), amount.alias("amount"))


def _with_flags(df: DataFrame, keys: Sequence[str], moves: Sequence[Move], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Amounts summed per key, department and which rules a row meets.

    The rules are tested in the scan and the rows shrink to a few sums before the shuffle, so
    moving amounts around costs nothing that grows with the table.
    """
    flags = {f"_move{i}": F.coalesce(m.test, F.lit(False)) for i, m in enumerate(moves)} | dict(extra or {})
    by = [*keys, "department", *[test.alias(name) for name, test in flags.items()]]
    return df.groupBy(*by).agg(F.sum("amount").alias("amount"))


def _spread(df: DataFrame, entries: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """Each sum becomes its signed department entries."""
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return df.select(*keys, F.explode(kept).alias("_e")).select(*keys, "_e.department", "_e.amount")


def reallocate(df: DataFrame, moves: Sequence[Move], keys: Sequence[str] = ()) -> DataFrame:
    """Sums of known departments plus, per move, ``+amount`` to one and ``-amount`` from another.

    ``df``: department, amount and what the moves test. Summing the entries gives the
    departments after the moves; the grand total is untouched.
    """
    amount = F.col("amount")
    entries = [F.when(blank_to_null(F.col("department")).isNotNull(), _entry(F.col("department"), amount))]
    for i, move in enumerate(moves):
        entries.append(F.when(F.col(f"_move{i}"), _entry(move.to, amount)))
        if move.source:
            entries.append(F.when(F.col(f"_move{i}"), _entry(move.source, -amount)))
    return _spread(_with_flags(df, keys, moves), entries, keys)


def revenue(income: DataFrame, moves: Sequence[Move], keys: Sequence[str] = (), total: bool = False) -> DataFrame:
    """``income``: department, amount and what the moves test. The total leaves the moves out."""
    if total:
        known = income.where(blank_to_null(F.col("department")).isNotNull())
        return known.groupBy(*keys).agg(F.sum("amount").alias("revenue"))
    return reallocate(income, moves, keys).groupBy(*keys, "department").agg(F.sum("amount").alias("revenue"))


def employed(cost: DataFrame) -> DataFrame:
    """Cost rows of people still employed on that day."""
    return cost.where(F.col("quit_date").isNull() | (F.col("day") <= F.col("quit_date")))


def man_cost(cost: DataFrame, keys: Sequence[str] = (), total: bool = False) -> DataFrame:
    rows = employed(cost).where(blank_to_null(F.col("department")).isNotNull())
    by = list(keys) if total else [*keys, "department"]
    return rows.groupBy(*by).agg(F.sum("cost").alias("man_cost"))


def project_cost(
    expense: DataFrame, blank_to: str, moves: Sequence[Move], keys: Sequence[str] = (), total: bool = False
) -> DataFrame:
    """Expenses with a project code by department, plus what the rules add.

    Detail: blank codes go to ``blank_to`` and each move adds its rows. Total: only the blank
    codes are added. A sum that rounds to zero is missing.
    """
    amount = F.col("amount")
    has_code = blank_to_null(F.coalesce("project_code", F.lit(""))).isNotNull()
    known = blank_to_null(F.col("department")).isNotNull()
    if total:
        rows = expense.where(~has_code | known).select(*keys, "amount")
        by = list(keys)
    else:
        coded = F.col("_coded")
        entries = [
            F.when(known & coded, _entry(F.col("department"), amount)),
            F.when(~coded, _entry(blank_to, amount)),
            *[F.when(F.col(f"_move{i}"), _entry(m.to, amount)) for i, m in enumerate(moves)],
        ]
        rows = _spread(_with_flags(expense, keys, moves, {"_coded": has_code}), entries, keys)
        by = [*keys, "department"]
    value = F.sum("amount")
    return rows.groupBy(*by).agg(F.when(F.round(value, 2) != 0, value).alias("project_cost"))


def profit_loss(
    income: DataFrame,
    cost: DataFrame,
    expense: DataFrame,
    revenue_moves: Sequence[Move],
    blank_to: str,
    cost_moves: Sequence[Move],
    keys: Sequence[str] = (),
    total: bool = False,
) -> DataFrame:
    """Revenue, man cost, project cost, expense, profit and margin per key (and department)."""
    by = list(keys) if total else [*keys, "department"]
    parts = {
        "revenue": revenue(income, revenue_moves, keys, total),
        "man_cost": man_cost(cost, keys, total),
        "project_cost": project_cost(expense, blank_to, cost_moves, keys, total),
    }
    add, subtract = _blank_sum(1), _blank_sum(-1)
    return (
        drill_across(parts, by)
        .withColumn("expense", add(F.col("man_cost"), F.col("project_cost")))
        .withColumn("profit", subtract(F.col("revenue"), F.col("expense")))
        .withColumn("margin", ratio(F.col("profit"), F.col("revenue")))
    )


def profit_status(pl: DataFrame) -> DataFrame:
    """Label and colour of a profit; a missing profit has neither."""
    return pl.withColumn(
        "profit_status", F.when(F.col("profit") >= 0, "Profit").when(F.col("profit") < 0, "Loss")
    ).withColumn(  # fixed values: the display colours
        "profit_colour", F.when(F.col("profit") >= 0, "#4ade80").when(F.col("profit") < 0, "#f87171")
    )


def profit_split(pl: DataFrame) -> DataFrame:
    return pl.withColumn("profit_positive", F.when(F.col("profit") >= 0, F.col("profit"))).withColumn(
        "profit_negative", F.when(F.col("profit") < 0, F.col("profit"))
    )


def millions(amount: Column) -> Column:
    """Signed millions with two decimals; zero has no sign."""
    text = (amount / 1_000_000).cast("decimal(18,2)").cast("string")
    return F.concat(F.when(amount > 0, "+").otherwise(""), text, F.lit("M"))


def departments_at_risk(pl: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``losses / departments with a profit figure``, as text."""
    return (
        pl.where(F.col("profit").isNotNull() & blank_to_null(F.col("department")).isNotNull())
        .groupBy(*keys)
        .agg(F.count_if(F.col("profit") < 0).alias("losses"), F.count(F.lit(1)).alias("departments"))
        .select(*keys, F.concat_ws(" / ", F.col("losses").cast("string"), F.col("departments").cast("string")).alias("at_risk"))
    )


def best_month(pl: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Name and profit of the best month per key; equal profits give the greater name."""
    best = pl.groupBy(*keys).agg(F.max(F.struct("profit", "short_month")).alias("_best"))
    return best.select(
        *keys, F.concat(F.col("_best.short_month"), F.lit(" "), millions(F.col("_best.profit"))).alias("best_month")
    )


def span_bounds(df: DataFrame, start: str, finish: str) -> tuple[dt.date | None, dt.date | None]:
    """The first and the last day that any span of a table names: where open ends reach to."""
    row = df.agg(F.min(F.least(start, finish)).alias("low"), F.max(F.greatest(start, finish)).alias("high")).first()
    return row.low, row.high


def span_months(
    df: DataFrame, keys: Sequence[str], start: str, finish: str, weight: Column | None = None, low: dt.date | None = None, high: dt.date | None = None
) -> DataFrame:
    """Per key and month that a span touches: ``month``, ``spans``, and ``days``, the sum of weight x active days.

    A sweep: a span is two events, where it begins and where it ends, however long it is. An event has
    the days of its own month; the months between are counted by a running sum over the months with an event. So rows grow
    with spans, not with spans x months. Open ends reach to the bounds of the whole table, or to
    ``low`` and ``high``, where all spans are clipped if they are given; reversed spans give none.
    """
    weight = F.lit(1) if weight is None else weight
    rows = df.select(*keys, F.col(start).alias("_s"), F.col(finish).alias("_f"), weight.cast("bigint").alias("_w"))
    clipped = low is not None and high is not None
    if not clipped:
        rows = materialize(rows, "spans")
        low, high = span_bounds(rows, "_s", "_f")
    first, last = F.coalesce("_s", F.lit(low).cast("date")), F.coalesce("_f", F.lit(high).cast("date"))
    rows = rows.withColumn("_s", first).withColumn("_f", last).where("_s <= _f")
    if clipped:
        rows = rows.withColumn("_s", F.greatest("_s", F.lit(low))).withColumn("_f", F.least("_f", F.lit(high))).where("_s <= _f")

    def event(day: str, days: Column, opens: Column, closes: Column, begun: int) -> Column:
        n = F.lit(begun).cast("bigint")
        return F.struct(F.trunc(day, "month").alias("month"), (F.col("_w") * days).alias("days"), opens.alias("opens"), closes.alias("closes"), n.alias("begun"), (1 - n).alias("ended"))

    zero = F.lit(0).cast("bigint")
    within = F.trunc("_s", "month") == F.trunc("_f", "month")
    begin = event("_s", F.when(within, F.datediff("_f", "_s") + 1).otherwise(F.datediff(F.last_day("_s"), F.col("_s")) + 1), F.when(within, zero).otherwise(F.col("_w")), zero, 1)
    end = event("_f", F.when(within, F.lit(0)).otherwise(F.day("_f")), zero, F.when(within, zero).otherwise(F.col("_w")), 0)
    sums = [F.sum(f"_e.{c}").alias(c) for c in ("days", "opens", "closes", "begun", "ended")]
    per_month = rows.select(*keys, F.explode(F.array(begin, end)).alias("_e")).groupBy(*keys, "_e.month").agg(*sums)

    order = Window.partitionBy(*keys).orderBy("month")  # at most a calendar
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)

    def so_far(name: str, window) -> Column:
        return F.coalesce(F.sum(name).over(window), zero)

    swept = per_month.select(
        *keys,
        F.col("month").alias("_from"),
        "days",
        (so_far("opens", before) - so_far("closes", upto)).alias("_full_here"),  # weights of spans that cover the whole month
        (so_far("opens", upto) - so_far("closes", upto)).alias("_full_after"),
        (so_far("begun", upto) - so_far("ended", before)).alias("_spans_here"),
        (so_far("begun", upto) - so_far("ended", upto)).alias("_spans_after"),
        F.lead("month").over(order).alias("_next"),
    )
    gap = F.when(F.col("_spans_after") > 0, F.add_months("_next", -1))  # nothing is open behind the last event
    months = F.sequence("_from", F.coalesce(gap, F.col("_from")), F.expr("interval 1 month"))
    filled = swept.withColumn("month", F.explode(months))
    here = F.col("month") == F.col("_from")
    length = F.day(F.last_day("month"))
    return filled.select(
        *keys,
        "month",
        F.when(here, F.col("_spans_here")).otherwise(F.col("_spans_after")).alias("spans"),
        F.when(here, F.col("days") + F.col("_full_here") * length).otherwise(F.col("_full_after") * length).alias("days"),
    )


def percent_days(allocation: DataFrame, low: dt.date | None = None, high: dt.date | None = None) -> DataFrame:
    """Σ percent x active days per person, type and month, where it is not 0."""
    swept = span_months(allocation, ["person_id", "allocate_type"], "start_date", "finish_date", F.col("assign_percent"), low, high)
    return swept.where("days <> 0").select("person_id", "allocate_type", "month", F.col("days").alias("percent_days"))


def man_cost_with_idle(cost: DataFrame, allocation: DataFrame, low: dt.date | None = None, high: dt.date | None = None) -> DataFrame:
    """Man cost by allocation type, the unallocated rest as ``Idle``, and the full cost as total.

    Cost and shares meet per person and month, both aggregated. Only positive shares count;
    where the shares exceed the whole month nothing is idle.
    """
    monthly = (
        employed(cost)
        .where(blank_to_null(F.col("department")).isNotNull())
        .groupBy("person_id", F.trunc("day", "month").alias("month"))
        .agg(F.sum("cost").cast("double").alias("cost"))
    )
    whole = 100 * F.day(F.last_day("month"))
    shares = (
        percent_days(allocation, low, high)
        .groupBy("person_id", "month")
        .agg(  # as many entries as there are allocation types
            F.sum("percent_days").alias("_used"), F.collect_list(F.struct("allocate_type", "percent_days")).alias("_types")
        )
    )

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.cast("string").alias("allocate_type"), value.alias("value"))

    rest = whole - F.coalesce("_used", F.lit(0))
    typed = F.transform(
        F.filter("_types", lambda t: t["percent_days"] > 0),
        lambda t: entry(t["allocate_type"], F.col("cost") * t["percent_days"] / whole),
    )
    others = F.array(
        entry(F.lit("Idle"), F.when(rest > 0, F.col("cost") * rest / whole)), entry(F.lit(None), F.col("cost"))
    )
    entries = F.when(F.col("_types").isNull(), others).otherwise(F.concat(typed, others))
    return (
        monthly.join(shares, ["person_id", "month"], "left")
        .select(F.explode(entries).alias("_e"))
        .groupBy("_e.allocate_type")
        .agg(F.sum("_e.value").alias("man_cost"))
        .where(F.col("man_cost").isNotNull())
    )
