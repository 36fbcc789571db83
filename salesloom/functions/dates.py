"""Date helpers of the measures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(day: Column, first: dt.date, last: dt.date) -> Column:
    """Both days included, written half-open: right for dates and timestamps, and a plain
    comparison with the stored column, so it is pushed to the scan."""
    return (day >= F.lit(first)) & (day < F.lit(last + dt.timedelta(days=1)))


def in_year_to_date(day: Column, as_of: dt.date) -> Column:
    """From 1 January of the reporting year up to the reporting date."""
    return in_range(day, dt.date(as_of.year, 1, 1), as_of)


def in_year(day: Column, year: int) -> Column:
    return in_range(day, dt.date(year, 1, 1), dt.date(year, 12, 31))


def in_month(day: Column, year: int, month: int) -> Column:
    following = dt.date(year + month // 12, month % 12 + 1, 1)
    return in_range(day, dt.date(year, month, 1), following - dt.timedelta(days=1))


def month_text(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def month_sort(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def days_inclusive(first: Column, last: Column) -> Column:
    return F.datediff(last, first) + 1


def days_in_month(day: Column) -> Column:
    return F.day(F.last_day(day))


def aging_bucket(days: Column) -> Column:
    return F.when(days <= 30, "0-30").when(days <= 60, "31-60").when(days <= 90, "61-90").otherwise(">90")


def with_month_spine(months, first: Column, last: Column):
    """Month starts from ``first`` to ``last`` (both inclusive) of a one-row frame, one row each."""
    return months.select(F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month"))
