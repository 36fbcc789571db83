"""The measure catalogue and the shapes of aggregation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from salesloom.functions.dates import in_range, in_year_to_date, with_month_spine
from salesloom.functions.values import ratio, safe_number
from salesloom.operators.measures import (
    MEASURES,
    distinct_count_blank,
    drill_across,
    measure_by,
    register_measure,
)
from salesloom.operators.ordered import previous_value, running_total
from salesloom.operators.rank import recent_n
from salesloom.plans.registry import query
from salesloom.plans.role_sql import AS_OF_SQL
from salesloom.plans.shapes import money, rate, sql_money, sql_rate, whole
from salesloom.sources.roles import AS_OF, MONEY, PLAN_DAYS

ACTIVITY_AS_OF = dt.date(2024, 1, 20)  # the events are of another year than the orders


def facts(r) -> dict:
    """The facts with the dimensions the queries group by; unused columns are pruned."""
    owner = r.deal_owner.select("deal_id", "person_id")
    return {
        "deal": r.deal_core.join(r.account.select("account_id", "industry", "province"), "account_id", "left"),
        "actual": r.actual,
        "target": r.target,
        "activity": r.activity.join(owner, "deal_id", "left"),
    }


def _deal_measure(key: str, name: str, sql_expr: str, column) -> None:
    """Register one deal measure grouped by industry."""
    grouped = f"SELECT industry, {sql_expr} FROM deal_core LEFT JOIN account USING (account_id) GROUP BY 1"
    sql = f"SELECT * FROM ({grouped}) WHERE {name} IS NOT NULL"

    @query(key, sql)
    def _(r):
        rows = measure_by({"deal": facts(r)["deal"]}, name, ["industry"], AS_OF)
        return rows.select("industry", column(F.col(name), name))


REALISED = "(SELECT deal_id, CAST(sum(amount) AS DECIMAL(12,2)) AS actual_amount FROM actual GROUP BY 1)"


def realised(r):
    """Deals with what their lines brought in, summed per deal before the join."""
    amounts = r.actual.groupBy("deal_id").agg(F.sum("amount").cast(MONEY).alias("actual_amount"))
    return facts(r)["deal"].join(amounts, "deal_id", "left")


@query(
    "m_total_actual",
    f"""
SELECT * FROM (SELECT industry, {sql_money("sum(coalesce(actual_amount, 0)) FILTER (status = 'Won')", "total_actual")}
FROM deal_core LEFT JOIN {REALISED} USING (deal_id) LEFT JOIN account USING (account_id) GROUP BY 1) WHERE total_actual IS NOT NULL""",
)
def _(r):
    return measure_by({"deal": realised(r)}, "total_actual", ["industry"], AS_OF).select("industry", money("total_actual", "total_actual"))


WON, OPEN, LOST = "status = 'Won'", "status = 'Open'", "status IN ('Lost','Cancelled')"

_deal_measure("m_total_plan", "total_plan", sql_money("sum(plan_amount)", "total_plan"), money)
_deal_measure("m_avg_deal_size", "avg_deal_size", sql_rate("CAST(sum(plan_amount) AS DOUBLE) / count(*)", "avg_deal_size"), rate)
_deal_measure("m_opp_count", "opp_count", "count(*) AS opp_count", whole)
_deal_measure("m_won_count", "won_count", f"count(*) FILTER ({WON}) AS won_count", whole)
_deal_measure("m_lost_count", "lost_count", f"count(*) FILTER ({LOST}) AS lost_count", whole)
_deal_measure("m_open_count", "open_count", f"count(*) FILTER ({OPEN}) AS open_count", whole)
_deal_measure(
    "m_win_rate",
    "win_rate",
    sql_rate("count(*) FILTER (status = 'Won') / nullif(count(*) FILTER (status IN ('Won','Lost','Cancelled')), 0)", "win_rate"),
    rate,
)
_deal_measure("m_avg_possibility", "avg_possibility", sql_rate("avg(possibility)", "avg_possibility"), rate)
_deal_measure("m_low_probability", "low_probability", f"count(*) FILTER ({OPEN} AND possibility < 50) AS low_probability", whole)
_deal_measure("m_at_risk", "at_risk", f"count(*) FILTER ({OPEN} AND (aging_days > 90 OR possibility < 30)) AS at_risk", whole)
_deal_measure("m_avg_aging", "avg_aging", sql_rate(f"avg(aging_days) FILTER ({OPEN})", "avg_aging"), rate)
_deal_measure("m_max_aging", "max_aging", f"CAST(max(aging_days) FILTER ({OPEN}) AS BIGINT) AS max_aging", whole)
_deal_measure("m_stale", "stale", f"count(*) FILTER ({OPEN} AND aging_days > 90) AS stale", whole)


@query("p_won_status", f"SELECT status, count(*) FILTER ({WON}) AS won_count FROM deal_core GROUP BY 1")
def _(r):
    """The won count under a grouping by status: all of it stands at one status."""
    rows = measure_by({"deal": facts(r)["deal"]}, "won_count", ["status"], AS_OF)
    return rows.select("status", whole(F.col("won_count"), "won_count"))


_deal_measure("p_forecast", "forecast", sql_money(f"sum(plan_amount * possibility) FILTER ({OPEN}) / 100", "forecast"), money)
_deal_measure(
    "p_pipeline_3m",
    "pipeline_3m",
    sql_money(
        f"sum(plan_amount) FILTER ({OPEN} AND est_close BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + INTERVAL 3 MONTH)", "pipeline_3m"
    ),
    money,
)


@query("m_total_target", f"SELECT person_id, {sql_money('sum(target_amount)', 'target')} FROM target GROUP BY 1")
def _(r):
    return measure_by(facts(r), "target", ["person_id"]).select("person_id", money("target", "target"))


BY_PERSON_SQL = """
  SELECT person_id, actual, target FROM (SELECT person_id, sum(amount) AS actual FROM actual GROUP BY 1)
  FULL JOIN (SELECT person_id, sum(target_amount) AS target FROM target GROUP BY 1) USING (person_id)"""


@query(
    "m_achievement",
    f"SELECT person_id, {sql_rate('coalesce(CAST(actual AS DOUBLE) / nullif(CAST(target AS DOUBLE), 0), 0)', 'achievement')} FROM by_person",
    by_person=BY_PERSON_SQL,
)
def _(r):
    return measure_by(facts(r), "achievement", ["person_id"]).select("person_id", rate("achievement", "achievement"))


@query(
    "m_target_variance",
    f"SELECT person_id, {sql_money('coalesce(actual, 0) - coalesce(target, 0)', 'target_variance')} FROM by_person",
    by_person=BY_PERSON_SQL,
)
def _(r):
    return measure_by(facts(r), "target_variance", ["person_id"]).select("person_id", money("target_variance", "target_variance"))


@query("m_activity_count", "SELECT activity_type, count(*) AS activity_count FROM activity GROUP BY 1")
def _(r):
    return measure_by({"activity": r.activity}, "activity_count", ["activity_type"])


ACTIVE_SQL = """
SELECT activity_type, count(DISTINCT person_id) + max(CASE WHEN person_id IS NULL THEN 1 ELSE 0 END) AS active_sales
FROM activity LEFT JOIN deal_owner USING (deal_id) GROUP BY 1"""


@query("m_active_sales", ACTIVE_SQL)
def _(r):
    return measure_by(facts(r), "active_sales", ["activity_type"])


@query(
    "m_ytd",
    f"""
SELECT industry, {sql_money("sum(coalesce(actual_amount, 0)) FILTER (status = 'Won')", 'total_actual')}, count(*) FILTER (status = 'Won') AS won_count,
       {sql_rate("coalesce(count(*) FILTER (status = 'Won') / nullif(count(*) FILTER (status IN ('Won','Lost','Cancelled')), 0), 0)", 'win_rate')}
FROM deal_core LEFT JOIN {REALISED} USING (deal_id) LEFT JOIN account USING (account_id) WHERE est_close BETWEEN DATE '2001-01-01' AND {AS_OF_SQL} GROUP BY 1""",
)
def _(r):
    """The year to date by the plan date of the deals, so many days after the stored date that the scan can filter on it."""
    deals = realised(r).withColumn("plan_date", F.col("est_close"))
    ahead = dt.timedelta(days=PLAN_DAYS)
    stored = in_range(F.col("created_at"), dt.date(AS_OF.year, 1, 1) - ahead, AS_OF - ahead)
    rows = measure_by({"deal": deals}, ["total_actual", "won_count", "win_rate"], ["industry"], AS_OF, where=stored, year_to_date=True)
    return rows.select("industry", money("total_actual", "total_actual"), "won_count", rate("win_rate", "win_rate"))


@query(
    "m_activity_ytd",
    "SELECT activity_type, count(*) AS activity_count FROM activity WHERE activity_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' GROUP BY 1",
)
def _(r):
    return measure_by({"activity": r.activity}, "activity_count", ["activity_type"], ACTIVITY_AS_OF, year_to_date=True)


# ---- Named but undefined in the reference; the definitions are ours ---------------------


@query("p_target", f"SELECT target_month, person_id, {sql_money('target_amount', 'target')} FROM target")
def _(r):
    return measure_by(facts(r), "target", ["target_month", "person_id"]).select("target_month", "person_id", money("target", "target"))


@query(
    "p_actual",
    f"""
SELECT CAST(date_trunc('month', actual_date) AS DATE) AS month, person_id, {sql_money('sum(amount)', 'actual')} FROM actual GROUP BY 1, 2""",
)
def _(r):
    rows = r.actual.withColumn("month", F.trunc("actual_date", "month"))
    return measure_by({"actual": rows}, "actual", ["month", "person_id"]).select("month", "person_id", money("actual", "actual"))


@query(
    "p_plan",
    f"SELECT CAST(date_trunc('month', est_close) AS DATE) AS plan_month, {sql_money('sum(plan_amount)', 'plan')} FROM deal_core GROUP BY 1",
)
def _(r):
    rows = r.deal_core.withColumn("plan_month", F.trunc("est_close", "month"))
    return measure_by({"deal": rows}, "total_plan", ["plan_month"]).select("plan_month", money("total_plan", "plan"))


YTD_SQL = f"BETWEEN DATE '2001-01-01' AND {AS_OF_SQL}"


@query("p_target_ytd", f"SELECT person_id, {sql_money('sum(target_amount)', 'target')} FROM target WHERE target_month {YTD_SQL} GROUP BY 1")
def _(r):
    return measure_by(facts(r), "target", ["person_id"], AS_OF, year_to_date=True).select("person_id", money("target", "target"))


@query("p_actual_ytd", f"SELECT person_id, {sql_money('sum(amount)', 'actual')} FROM actual WHERE actual_date {YTD_SQL} GROUP BY 1")
def _(r):
    return measure_by(facts(r), "actual", ["person_id"], AS_OF, year_to_date=True).select("person_id", money("actual", "actual"))


@query(
    "p_plan_ytd",
    f"SELECT industry, {sql_money('sum(plan_amount)', 'plan')} FROM deal_core LEFT JOIN account USING (account_id) WHERE created {YTD_SQL} GROUP BY 1",
)
def _(r):
    rows = measure_by({"deal": facts(r)["deal"]}, "total_plan", ["industry"], AS_OF, year_to_date=True)
    return rows.select("industry", money("total_plan", "plan"))


YTD_BY_PERSON_SQL = f"""
  SELECT person_id, actual, target FROM (SELECT person_id, sum(amount) AS actual FROM actual WHERE actual_date {YTD_SQL} GROUP BY 1)
  FULL JOIN (SELECT person_id, sum(target_amount) AS target FROM target WHERE target_month {YTD_SQL} GROUP BY 1) USING (person_id)"""


@query(
    "p_achievement_ytd",
    f"SELECT person_id, {sql_rate('coalesce(CAST(actual AS DOUBLE) / nullif(CAST(target AS DOUBLE), 0), 0)', 'achievement')} FROM by_person",
    by_person=YTD_BY_PERSON_SQL,
)
def _(r):
    rows = measure_by(facts(r), "achievement", ["person_id"], AS_OF, year_to_date=True)
    return rows.select("person_id", rate("achievement", "achievement"))


def monthly(df, day: str, amount: str, name: str):
    """One row per calendar month without gaps; months without rows count as zero."""
    sums = df.groupBy(F.trunc(day, "month").alias("month")).agg(F.sum(amount).alias(name))
    bounds = sums.agg(F.min("month").alias("low"), F.max("month").alias("high"))
    spine = with_month_spine(bounds, F.col("low"), F.col("high"))
    return spine.join(sums, "month", "left").withColumn(name, F.coalesce(name, F.lit(0)))


ACCUM_SQL = """
SELECT month, CAST(round({v}, 2) AS DOUBLE) AS {v}, CAST(round(sum({v}) OVER (ORDER BY month), 2) AS DOUBLE) AS accumulated
FROM (SELECT CAST(date_trunc('month', {d}) AS DATE) AS month, sum({a}) AS {v} FROM {t} GROUP BY 1)"""


@query("p_accum_target", ACCUM_SQL.format(v="target", d="target_month", a="target_amount", t="target"))
def _(r):
    rows = running_total(monthly(r.target, "target_month", "target_amount", "target"), "month", ["target"])
    return rows.select("month", money("target", "target"), money("target_running", "accumulated"))


@query("p_accum_actual", ACCUM_SQL.format(v="actual", d="actual_date", a="amount", t="actual"))
def _(r):
    rows = running_total(monthly(r.actual, "actual_date", "amount", "actual"), "month", ["actual"])
    return rows.select("month", money("actual", "actual"), money("actual_running", "accumulated"))


@query(
    "ytd_total",
    """
SELECT month, CAST(round(sum(v) OVER (PARTITION BY year(month) ORDER BY month), 2) AS DOUBLE) AS actual_ytd
FROM (SELECT CAST(date_trunc('month', actual_date) AS DATE) AS month, sum(amount) AS v FROM actual GROUP BY 1)""",
)
def _(r):
    rows = running_total(monthly(r.actual, "actual_date", "amount", "actual"), "month", ["actual"], reset=[F.year("month")])
    return rows.select("month", money("actual_running", "actual_ytd"))


@query(
    "running_total",
    """
SELECT person_id, month, CAST(round(sum(v) OVER (PARTITION BY person_id ORDER BY month), 2) AS DOUBLE) AS accumulated
FROM (SELECT person_id, CAST(date_trunc('month', actual_date) AS DATE) AS month, sum(amount) AS v FROM actual GROUP BY 1, 2)""",
)
def _(r):
    sums = r.actual.groupBy("person_id", F.trunc("actual_date", "month").alias("month")).agg(F.sum("amount").alias("actual"))
    return running_total(sums, "month", ["actual"], by=["person_id"]).select("person_id", "month", money("actual_running", "accumulated"))


@query(
    "p_coverage",
    f"""
SELECT person_id, {sql_rate("coalesce(CAST(pipeline AS DOUBLE) / nullif(CAST(coalesce(target, 0) - coalesce(actual, 0) AS DOUBLE), 0), 0)", 'coverage')}
FROM by_person FULL JOIN (
  SELECT person_id, sum(plan_amount) FILTER ({OPEN} AND est_close BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + INTERVAL 3 MONTH) AS pipeline
  FROM deal_core LEFT JOIN deal_owner USING (deal_id) GROUP BY 1) p USING (person_id)
WHERE person_id IS NOT NULL""",
    by_person=YTD_BY_PERSON_SQL,
)
def _(r):
    """Open plan of the next three months against what is missing to this year's target."""
    f = facts(r)
    deals = r.deal_core.join(r.deal_owner.select("deal_id", "person_id"), "deal_id", "left")
    parts = {
        "year": measure_by(f, ["actual", "target"], ["person_id"], AS_OF, year_to_date=True),
        "pipeline": measure_by({"deal": deals}, ["pipeline_3m", "opp_count"], ["person_id"], AS_OF).drop("opp_count"),
    }
    missing = F.coalesce("target", F.lit(0)) - F.coalesce("actual", F.lit(0))
    merged = drill_across(parts, ["person_id"]).where(F.col("person_id").isNotNull())
    return merged.select("person_id", rate(ratio(F.col("pipeline_3m"), missing), "coverage"))


@query(
    "p_winrate_ytd",
    f"""
SELECT province, {sql_rate("coalesce(count(*) FILTER (status = 'Won') / nullif(count(*) FILTER (status IN ('Won','Lost')), 0), 0)", 'win_rate')}
FROM deal_core LEFT JOIN account USING (account_id) WHERE created {YTD_SQL} GROUP BY 1""",
)
def _(r):
    rows = measure_by({"deal": facts(r)["deal"]}, "win_rate", ["province"], AS_OF, year_to_date=True)
    return rows.select("province", rate("win_rate", "win_rate"))


@query("p_activity", "SELECT deal_id, count(*) AS activity_count FROM activity GROUP BY 1")
def _(r):
    return measure_by({"activity": r.activity}, "activity_count", ["deal_id"])


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "p_activity_by_type",
    "SELECT person_id, "
    + ", ".join(f"count(*) FILTER (activity_type = '{t}') AS {t}" for t in TYPES)
    + " FROM activity LEFT JOIN deal_owner USING (deal_id) GROUP BY 1",
)
def _(r):
    """A fixed list of types: counted in one pass, without asking the data for the columns first."""
    counts = [F.count_if(F.col("activity_type") == t).alias(t) for t in TYPES]
    return facts(r)["activity"].groupBy("person_id").agg(*counts)


MOVEMENT_SQL = """
  SELECT event_id, user_id AS deal_id, ts, value AS current, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events"""


def movements(r):
    """Each value of a deal beside the one before; hours cut a busy deal into many tasks."""
    rows = r.table("events").select("event_id", F.col("user_id").alias("deal_id"), "ts", F.col("value").alias("current"))
    return previous_value(rows, "deal_id", ["ts", "event_id"], "current", F.date_trunc("hour", F.col("ts")))


@query("previous_value", "SELECT event_id, deal_id, current, previous FROM movement", movement=MOVEMENT_SQL)
def _(r):
    return movements(r).select("event_id", "deal_id", "current", "previous")


@query(
    "p_possibility_delta",
    "SELECT event_id, deal_id, CAST(CAST(current AS DECIMAL(12,2)) - CAST(previous AS DECIMAL(12,2)) AS DOUBLE) AS delta FROM movement WHERE previous IS NOT NULL",
    movement=MOVEMENT_SQL,
)
def _(r):
    delta = F.col("current").cast("decimal(12,2)") - F.col("previous").cast("decimal(12,2)")
    return movements(r).where(F.col("previous").isNotNull()).select("event_id", "deal_id", delta.cast("double").alias("delta"))


# ---- Shapes ----------------------------------------------------------------------------


@query(
    "ratio_guarded",
    f"SELECT p_partkey, {sql_rate('coalesce(p_retailprice / nullif(p_size - 10, 0), 0)', 'price_per_size')} FROM part",
)
def _(r):
    return r.table("part").select("p_partkey", rate(ratio(F.col("p_retailprice"), F.col("p_size") - 10), "price_per_size"))


@query(
    "conditional_count",
    "SELECT person_id, count(*) FILTER (status = 'Won' AND possibility >= 70) AS sure_wins FROM deal GROUP BY 1",
)
def _(r):
    deals = r.deal_core.join(r.deal_owner, "deal_id", "left")
    sure = (F.col("status") == "Won") & (F.col("possibility") >= 70)
    return deals.groupBy("person_id").agg(F.count_if(sure).alias("sure_wins"))


@query("distinct_count_blank", ACTIVE_SQL.replace("active_sales", "people"))
def _(r):
    return facts(r)["activity"].groupBy("activity_type").agg(distinct_count_blank("person_id").alias("people"))


@query(
    "iterate_sum",
    f"""
SELECT person_id, {sql_money('sum(amount)', 'total')}, {sql_money('max(amount)', 'largest')}, count(*) AS lines FROM actual GROUP BY 1""",
)
def _(r):
    return r.actual.groupBy("person_id").agg(
        money(F.sum("amount"), "total"), money(F.max("amount"), "largest"), F.count(F.lit(1)).alias("lines")
    )


@query(
    "nested_iterate",
    f"""
SELECT person_id, {sql_money('max(v)', 'best_month')}, {sql_money('sum(v)', 'total')}, count(*) AS months
FROM (SELECT person_id, date_trunc('month', actual_date) AS m, sum(amount) AS v FROM actual GROUP BY 1, 2) GROUP BY 1""",
)
def _(r):
    months = r.actual.groupBy("person_id", F.trunc("actual_date", "month").alias("month")).agg(F.sum("amount").alias("_v"))
    return months.groupBy("person_id").agg(
        money(F.max("_v"), "best_month"), money(F.sum("_v"), "total"), F.count(F.lit(1)).alias("months")
    )


@query(
    "group_total",
    f"""
SELECT industry, status, CAST(grouping(industry, status) AS BIGINT) AS level,
       CASE grouping(industry, status) WHEN 0 THEN CAST(round(sum(plan_amount), 2) AS DOUBLE) ELSE CAST(round(max(plan_amount), 2) AS DOUBLE) END AS value
FROM deal_core JOIN account USING (account_id) GROUP BY ROLLUP (industry, status)""",
)
def _(r):
    """Detail rows show the sum, totals another formula; the grouping level decides."""
    rows = r.deal_core.join(r.account.select("account_id", "industry"), "account_id")
    rolled = rows.rollup("industry", "status").agg(
        F.grouping_id().alias("level"), F.sum("plan_amount").alias("_sum"), F.max("plan_amount").alias("_max")
    )
    value = F.when(F.col("level") == 0, F.col("_sum")).otherwise(F.col("_max"))
    return rolled.select("industry", "status", whole("level", "level"), money(value, "value"))


@query(
    "top_by_total",
    f"""
SELECT solution, industry, count(*) AS deals, {sql_money("sum(plan_amount) FILTER (status = 'Open')", 'pipeline')}
FROM deal JOIN account USING (account_id) GROUP BY 1, 2""",
)
def _(r):
    rows = r.deal.join(r.account.select("account_id", "industry"), "account_id")
    return rows.groupBy("solution", "industry").agg(
        F.count(F.lit(1)).alias("deals"), money(F.sum(F.when(F.col("status") == "Open", F.col("plan_amount"))), "pipeline")
    )


@query(
    "recent_n",
    """
SELECT deal_id, activity_id, rank FROM (
  SELECT deal_id, activity_id, CAST(row_number() OVER (PARTITION BY deal_id ORDER BY activity_date DESC, activity_id) AS INTEGER) AS rank FROM activity)
WHERE rank <= 50""",
)
def _(r):
    order = [F.col("activity_date").desc(), F.col("activity_id")]
    return recent_n(r.activity.select("deal_id", "activity_id", "activity_date"), "deal_id", order, 50).select("deal_id", "activity_id", "rank")


@query(
    "safe_number",
    """
SELECT doc_id, coalesce(TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'abc' WHEN doc_id % 3 = 1 THEN '' ELSE CAST(n_chars AS VARCHAR) END AS DECIMAL(18,2)), -1)::DOUBLE AS number
FROM documents""",
)
def _(r):
    kind = F.col("doc_id") % 3
    cell = F.when(kind == 0, "abc").when(kind == 1, "").otherwise(F.format_string(" %,d ", F.col("n_chars")))
    return r.table("documents").select("doc_id", safe_number(cell, -1).cast("double").alias("number"))


@query(
    "register_measure",
    f"SELECT industry, {sql_money('sum(plan_amount) FILTER (possibility >= 70)', 'sure_plan')} FROM deal_core LEFT JOIN account USING (account_id) GROUP BY 1",
)
def _(r):
    """A measure a user adds, grouped like the built-in ones."""
    if "sure_plan" not in MEASURES:
        register_measure("sure_plan", "deal", lambda d: F.sum(F.when(F.col("possibility") >= 70, F.col("plan_amount"))))
    return measure_by({"deal": facts(r)["deal"]}, "sure_plan", ["industry"]).select("industry", money("sure_plan", "sure_plan"))


@query(
    "ytd_scalar",
    f"SELECT count(*) AS deals, {sql_money('sum(plan_amount)', 'plan')} FROM deal_core WHERE created {YTD_SQL}",
)
def _(r):
    rows = r.deal_core.where(in_year_to_date(F.col("created_at"), AS_OF))
    return rows.agg(F.count(F.lit(1)).alias("deals"), money(F.sum("plan_amount"), "plan"))
