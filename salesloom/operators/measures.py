"""The measure registry: named aggregates over facts, grouped by any dimensions in one pass."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.dates import in_year_to_date
from salesloom.functions.values import ratio, safe_number

WON, LOST, OPEN = ("Won",), ("Lost", "Cancelled"), ("Open",)


@dataclass(frozen=True)
class Measure:
    """An aggregate expression over one fact."""

    fact: str
    expr: Callable[[dt.date], Column]


@dataclass(frozen=True)
class Derived:
    """A row expression over other measures, which may come from different facts."""

    inputs: tuple[str, ...]
    expr: Callable[..., Column]


MEASURES: dict[str, Measure | Derived] = {}

# The date a fact is filtered by for a year-to-date measure: the first of these it has. A deal is in
# the year of its plan date where it has one.
FACT_DATE = {
    "deal": ("plan_date", "created_at", "created"),
    "actual": ("actual_at", "actual_date"),
    "target": ("target_month",),
    "activity": ("activity_at", "activity_date"),
}


def register_measure(name: str, fact: str, expr: Callable[[dt.date], Column]) -> None:
    """Add a user's own measure; it can then be grouped by any dimensions of the fact."""
    MEASURES[name] = Measure(fact, expr)


def register_derived(name: str, inputs: Sequence[str], expr: Callable[..., Column]) -> None:
    MEASURES[name] = Derived(tuple(inputs), expr)


def _is(statuses: Sequence[str]) -> Column:
    return F.col("status").isin(*statuses)


def _plan(default: float | None = 0) -> Column:
    return safe_number(F.col("plan_amount"), default)


def _possibility(default: float | None = None) -> Column:
    return safe_number(F.col("possibility"), default)


def _aging() -> Column:
    return safe_number(F.col("aging_days"), 0)


def _zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def _blank_sum(sign: int = 1) -> Callable[[Column, Column], Column]:
    """a + b (or a - b) where a missing side counts as zero and two missing sides stay missing."""
    return lambda a, b: F.when(a.isNotNull() | b.isNotNull(), _zero(a) + sign * _zero(b))


register_measure("total_plan", "deal", lambda d: F.sum(_plan()))
register_measure("total_actual", "deal", lambda d: F.sum(F.when(_is(WON), safe_number(F.col("actual_amount"), 0))))
register_measure("opp_count", "deal", lambda d: F.count(F.lit(1)))
register_measure("won_count", "deal", lambda d: F.count_if(_is(WON)))
register_measure("lost_count", "deal", lambda d: F.count_if(_is(LOST)))
register_measure("open_count", "deal", lambda d: F.count_if(_is(OPEN)))
register_measure("avg_deal_size", "deal", lambda d: ratio(F.sum(_plan()), F.count(F.lit(1))))
register_measure("win_rate", "deal", lambda d: ratio(F.count_if(_is(WON)), F.count_if(_is(WON + LOST))))
register_measure("avg_possibility", "deal", lambda d: F.avg(_possibility().cast("double")))
register_measure("low_probability", "deal", lambda d: F.count_if(_is(OPEN) & (_possibility(100) < 50)))
register_measure(
    "at_risk", "deal", lambda d: F.count_if(_is(OPEN) & ((_aging() > 90) | (_possibility(100) < 30)))
)
register_measure("avg_aging", "deal", lambda d: F.avg(F.when(_is(OPEN), _aging().cast("double"))))
register_measure("max_aging", "deal", lambda d: F.max(F.when(_is(OPEN), _aging())))
register_measure("stale", "deal", lambda d: F.count_if(_is(OPEN) & (_aging() > 90)))
register_measure("forecast", "deal", lambda d: F.sum(F.when(_is(OPEN), _plan() * _possibility(0) / 100)))
register_measure(
    "pipeline_3m",
    "deal",
    lambda d: F.sum(
        F.when(_is(OPEN) & F.col("est_close").between(F.lit(d), F.add_months(F.lit(d), 3)), _plan())
    ),
)
register_measure("target", "target", lambda d: F.sum("target_amount"))
register_measure("actual", "actual", lambda d: F.sum("amount"))
register_measure("activity_count", "activity", lambda d: F.count(F.lit(1)))
register_measure(
    "active_sales",
    "activity",
    # a blank owner is one more value, as the reference counts it
    lambda d: F.countDistinct("person_id") + F.max(F.when(F.col("person_id").isNull(), 1).otherwise(0)),
)
register_derived("achievement", ("actual", "target"), ratio)
register_derived("target_variance", ("actual", "target"), _blank_sum(-1))


def _inputs(names: Sequence[str]) -> list[str]:
    """The single-fact measures behind a list of names, each once."""
    found: list[str] = []
    for name in names:
        measure = MEASURES[name]
        for part in _inputs(measure.inputs) if isinstance(measure, Derived) else [name]:
            if part not in found:
                found.append(part)
    return found


def _value(name: str) -> Column:
    measure = MEASURES[name]
    if isinstance(measure, Derived):
        return measure.expr(*[_value(i) for i in measure.inputs])
    return F.col(name)


def measure_by(
    facts: Mapping[str, DataFrame],
    names: str | Sequence[str],
    dims: Sequence[str] = (),
    as_of: dt.date | None = None,
    where: Column | None = None,
    year_to_date: bool = False,
) -> DataFrame:
    """Measures by dimensions: one aggregation per fact, however many measures it serves.

    Facts meet at the common grain (drill-across); derived measures are computed there.
    Rows whose measures are all missing are dropped.
    """
    names = [names] if isinstance(names, str) else list(names)
    as_of = as_of or dt.date.today()
    by_fact: dict[str, list[str]] = {}
    for name in _inputs(names):
        by_fact.setdefault(MEASURES[name].fact, []).append(name)
    parts = {}
    for fact, members in by_fact.items():
        rows = facts[fact]
        if where is not None:
            rows = rows.where(where)
        if year_to_date:
            day = next(c for c in FACT_DATE[fact] if c in rows.columns)
            rows = rows.where(in_year_to_date(F.col(day), as_of))
        parts[fact] = rows.groupBy(*dims).agg(*[MEASURES[m].expr(as_of).alias(m) for m in members])
    merged = drill_across(parts, dims)
    present = F.lit(False)
    for name in names:
        present = present | _value(name).isNotNull()
    return merged.select(*dims, *[_value(n).alias(n) for n in names]).where(present)


def drill_across(parts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Bring aggregated facts to one row per key; a missing key is a group of its own.

    A union and one more aggregation of the few aggregated rows: unlike an outer join it
    also matches null keys, and it takes any number of facts.
    """
    frames = list(parts.values())
    if len(frames) == 1:
        return frames[0]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    values = [c for c in whole.columns if c not in keys]
    return whole.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def distinct_count_blank(col: str) -> Column:
    """Distinct values, a blank counting as one of them."""
    return F.countDistinct(col) + F.max(F.when(F.col(col).isNull(), 1).otherwise(0))
