"""Worked business questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesloom.functions.dates import aging_bucket, in_month, in_year, in_year_to_date, month_sort, month_text
from salesloom.functions.values import contains_any, ratio
from salesloom.operators.measures import drill_across
from salesloom.operators.ordered import running_total
from salesloom.operators.rank import md_row_table, row_cap, top_contributors, topn, topn_per
from salesloom.plans.metrics import MOVEMENT_SQL, YTD_SQL, facts, monthly, movements
from salesloom.plans.registry import query
from salesloom.plans.shapes import money, rate, sql_money, sql_rate, whole
from salesloom.sources.roles import AS_OF, has_status

YEAR = AS_OF.year


def _actual_target(r, keys, actual_where=None, target_where=None):
    """Actual and target at a common grain: two facts, each aggregated once, then merged."""
    actual = r.actual.withColumn("month", F.trunc("actual_date", "month"))
    target = r.target.withColumnRenamed("target_month", "month")
    if actual_where is not None:
        actual = actual.where(actual_where(F.col("actual_at")))
        target = target.where((target_where or actual_where)(F.col("month")))
    return drill_across(
        {
            "actual": actual.groupBy(*keys).agg(F.sum("amount").alias("actual")),
            "target": target.groupBy(*keys).agg(F.sum("target_amount").alias("target")),
        },
        keys,
    )


BOTH = f"{sql_money('actual', 'actual')}, {sql_money('target', 'target')}"


@query(
    "actual_vs_target_month",
    f"""
SELECT strftime(month, '%b %Y') AS month_year, CAST(year(month) * 100 + month(month) AS BIGINT) AS month_sort, {BOTH}
FROM (SELECT CAST(date_trunc('month', actual_date) AS DATE) AS month, sum(amount) AS actual FROM actual WHERE year(actual_date) = 2001 GROUP BY 1)
FULL JOIN (SELECT target_month AS month, sum(target_amount) AS target FROM target WHERE year(target_month) = 2001 GROUP BY 1) USING (month)""",
)
def _(r):
    rows = _actual_target(r, ["month"], lambda d: in_year(d, YEAR))
    return rows.select(
        month_text(F.col("month")).alias("month_year"), whole(month_sort(F.col("month")), "month_sort"), money("actual", "actual"), money("target", "target")
    ).orderBy("month_sort")


@query(
    "actual_vs_target_total",
    f"""
SELECT {sql_money('(SELECT sum(amount) FROM actual WHERE year(actual_date) = 2001 AND month(actual_date) = 5)', 'actual')},
       {sql_money("(SELECT sum(target_amount) FROM target WHERE target_month = DATE '2001-05-01')", 'target')}""",
)
def _(r):
    return _actual_target(r, [], lambda d: in_month(d, YEAR, 5)).select(money("actual", "actual"), money("target", "target"))


PERSON_YEAR_SQL = """
  SELECT person, actual, target FROM (SELECT person_id, sum(amount) AS actual FROM actual WHERE year(actual_date) = 2001 GROUP BY 1)
  FULL JOIN (SELECT person_id, sum(target_amount) AS target FROM target WHERE year(target_month) = 2001 GROUP BY 1) USING (person_id)
  JOIN salesperson USING (person_id)"""


def _person_year(r):
    rows = _actual_target(r, ["person_id"], lambda d: in_year(d, YEAR))
    return rows.join(r.salesperson.select("person_id", "person"), "person_id")


def top_sql(source: str, by: str, n: int, columns: str) -> str:
    return f"""
SELECT {columns} FROM {source}
WHERE {by} >= (SELECT min({by}) FROM (SELECT {by} FROM {source} WHERE {by} IS NOT NULL ORDER BY {by} DESC LIMIT {n}))"""


@query("top_sellers", top_sql("person_year", "actual", 10, f"person, {BOTH}"), person_year=PERSON_YEAR_SQL)
def _(r):
    return topn(_person_year(r), "actual", 10).select("person", money("actual", "actual"), money("target", "target"))


ACCOUNT_ACTUAL_SQL = """
  SELECT account_name, sum(amount) AS actual FROM actual JOIN deal_core USING (deal_id) JOIN account USING (account_id) GROUP BY 1"""


@query("top_accounts", top_sql("by_account", "actual", 10, f"account_name, {sql_money('actual', 'actual')}"), by_account=ACCOUNT_ACTUAL_SQL)
def _(r):
    """Summed per account id first; names join the few sums, not the lines."""
    sums = r.actual.join(r.deal_core.select("deal_id", "account_id"), "deal_id").groupBy("account_id").agg(F.sum("amount").alias("_a"))
    named = sums.join(r.account.select("account_id", "account_name"), "account_id").groupBy("account_name").agg(F.sum("_a").alias("actual"))
    return topn(named, "actual", 10).select("account_name", money("actual", "actual"))


@query(
    "top_open_deals",
    top_sql("open_deal", "plan_amount", 5, f"account_name, deal_name, {sql_money('plan_amount', 'pipeline')}"),
    open_deal="  SELECT * FROM deal_core JOIN account USING (account_id) WHERE status = 'Open'",
)
def top_open_deals(r):
    """Five largest open deals. The limit runs on deals alone; only the winners look up their account."""
    best = topn(r.deal_core.where(has_status("Open")).select("account_id", "deal_name", "plan_amount"), "plan_amount", 5)
    return best.join(r.account.select("account_id", "account_name"), "account_id").select(
        "account_name", "deal_name", money("plan_amount", "pipeline")
    )


@query(
    "lost_value_accounts",
    top_sql("lost", "lost_value", 10, f"account_name, {sql_money('lost_value', 'lost_value')}"),
    lost="  SELECT account_name, sum(plan_amount) AS lost_value FROM deal_core JOIN account USING (account_id) WHERE status = 'Lost' GROUP BY 1",
)
def _(r):
    sums = r.deal_core.where(has_status("Lost")).groupBy("account_id").agg(F.sum("plan_amount").alias("_v"))
    named = sums.join(r.account.select("account_id", "account_name"), "account_id").groupBy("account_name").agg(F.sum("_v").alias("lost_value"))
    return topn(named, "lost_value", 10).select("account_name", money("lost_value", "lost_value"))


@query(
    "lost_deals_possibility",
    top_sql("lost", "possibility", 10, f"deal_name, account_name, CAST(possibility AS BIGINT) AS possibility, {sql_money('plan_amount', 'plan')}"),
    lost="  SELECT * FROM deal_core LEFT JOIN account USING (account_id) WHERE status = 'Lost'",
)
def _(r):
    """All lost deals tied at the top possibility, as a ranking with ties returns them."""
    best = topn(r.deal_core.where(has_status("Lost")), "possibility", 10)
    return best.join(r.account.select("account_id", "account_name"), "account_id", "left").select(
        "deal_name", "account_name", whole("possibility", "possibility"), money("plan_amount", "plan")
    )


WINRATE_SQL = """
  SELECT account_name, count(*) FILTER (status = 'Won') AS won, count(*) AS closed, count(*) FILTER (status = 'Won') / count(*) AS win_rate
  FROM deal_core JOIN account USING (account_id) WHERE status IN ('Won','Lost') GROUP BY 1"""


def _winrate(r):
    closed = r.deal_core.where(has_status("Won", "Lost"))
    counts = closed.groupBy("account_id").agg(F.count_if(F.col("status") == "Won").alias("won"), F.count(F.lit(1)).alias("closed"))
    named = counts.join(r.account.select("account_id", "account_name"), "account_id")
    return named.groupBy("account_name").agg(F.sum("won").alias("won"), F.sum("closed").alias("closed")).withColumn(
        "win_rate", ratio(F.col("won"), F.col("closed"))
    )


@query(
    "winrate_accounts",
    top_sql("w", "win_rate", 10, f"account_name, won, closed, {sql_rate('win_rate', 'win_rate')}"),
    all_rates=WINRATE_SQL,
    w="  SELECT * FROM all_rates WHERE closed >= 3",
)
def _(r):
    return topn(_winrate(r).where("closed >= 3"), "win_rate", 10).select("account_name", "won", "closed", rate("win_rate", "win_rate"))


@query(
    "winrate_big_accounts",
    top_sql("w", "win_rate", 10, f"account_name, won, closed, {sql_rate('win_rate', 'win_rate')}"),
    all_rates=WINRATE_SQL,
    w="  SELECT * FROM all_rates WHERE closed > 10",
)
def _(r):
    return topn(_winrate(r).where("closed > 10"), "win_rate", 10).select("account_name", "won", "closed", rate("win_rate", "win_rate"))


@query(
    "possibility_drops",
    "SELECT deal_id, event_id, previous, current FROM movement WHERE current < previous",
    movement=MOVEMENT_SQL,
)
def _(r):
    return movements(r).where(F.col("current") < F.col("previous")).select("deal_id", "event_id", "previous", "current")


@query(
    "activity_by_person",
    """
SELECT person, count(*) AS activities, count(*) FILTER (activity_type = 'signup') AS appointments
FROM activity LEFT JOIN deal USING (deal_id) GROUP BY 1""",
)
def _(r):
    per_id = facts(r)["activity"].groupBy("person_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("activity_type") == "signup").alias("_s")
    )
    named = per_id.join(r.salesperson.select("person_id", "person"), "person_id", "left")
    return named.groupBy("person").agg(F.sum("_n").alias("activities"), F.sum("_s").alias("appointments"))


@query(
    "activity_person_type",
    "SELECT person_id, activity_type, count(*) AS activities FROM activity LEFT JOIN deal_owner USING (deal_id) GROUP BY 1, 2",
)
def _(r):
    return facts(r)["activity"].groupBy("person_id", "activity_type").agg(
        F.count(F.lit(1)).alias("activities")
    )


@query(
    "person_partial",
    f"SELECT {sql_money('sum(actual)', 'actual')}, {sql_money('sum(target)', 'target')} FROM person_year WHERE instr(lower(person), '00001') > 0",
    person_year=PERSON_YEAR_SQL,
)
def _(r):
    """A part of a name; the people are filtered first and reach both facts as a semi join."""
    people = r.salesperson.where(contains_any(F.col("person"), ["00001"])).select("person_id")
    actual = r.actual.where(in_year(F.col("actual_at"), YEAR)).join(people, "person_id", "left_semi")
    target = r.target.where(in_year(F.col("target_month"), YEAR)).join(people, "person_id", "left_semi")
    parts = {"actual": actual.agg(F.sum("amount").alias("actual")), "target": target.agg(F.sum("target_amount").alias("target"))}
    return drill_across(parts, []).select(money("actual", "actual"), money("target", "target"))


@query(
    "pipeline_by_solution",
    top_sql("s", "pipeline", 10, f"solution, {sql_money('pipeline', 'pipeline')}"),
    s="  SELECT solution, sum(plan_amount) AS pipeline FROM deal WHERE status = 'Open' AND solution IS NOT NULL GROUP BY 1",
)
def _(r):
    sums = r.deal.where(has_status("Open") & F.col("solution").isNotNull()).groupBy("solution").agg(F.sum("plan_amount").alias("pipeline"))
    return topn(sums, "pipeline", 10).select("solution", money("pipeline", "pipeline"))


@query("status_breakdown", f"SELECT status, count(*) AS deals, {sql_money('sum(plan_amount)', 'plan')} FROM deal_core GROUP BY 1")
def _(r):
    return r.deal_core.groupBy("status").agg(F.count(F.lit(1)).alias("deals"), money(F.sum("plan_amount"), "plan"))


@query(
    "longest_aging",
    top_sql("a", "oldest", 1, "person, CAST(oldest AS BIGINT) AS oldest, deals"),
    a="  SELECT person, max(aging_days) AS oldest, count(*) AS deals FROM deal WHERE status = 'Open' AND person IS NOT NULL GROUP BY 1",
)
def _(r):
    aged = r.deal.where(has_status("Open") & F.col("person").isNotNull()).groupBy("person").agg(
        F.max("aging_days").alias("oldest"), F.count(F.lit(1)).alias("deals")
    )
    return topn(aged, "oldest", 1).select("person", whole("oldest", "oldest"), "deals")


@query(
    "stuck_deals",
    f"""
SELECT deal_name, person, CAST(aging_days AS BIGINT) AS aging_days, {sql_money('plan_amount', 'plan')} FROM deal
WHERE status = 'Open' AND instr(lower(person), '00000007') > 0""",
)
def _(r):
    mine = has_status("Open") & contains_any(F.col("person"), ["00000007"])
    return r.deal.where(mine).select("deal_name", "person", whole("aging_days", "aging_days"), money("plan_amount", "plan"))


@query(
    "monthly_breakdown",
    """
SELECT month, CAST(round(v, 2) AS DOUBLE) AS actual, CAST(round(sum(v) OVER (ORDER BY month), 2) AS DOUBLE) AS accumulated FROM (
  SELECT m AS month, coalesce(v, 0) AS v
  FROM (SELECT CAST(unnest(generate_series(min(date_trunc('month', actual_date)), max(date_trunc('month', actual_date)), INTERVAL 1 MONTH)) AS DATE) AS m FROM actual WHERE person_id = 7)
  LEFT JOIN (SELECT CAST(date_trunc('month', actual_date) AS DATE) AS m, sum(amount) AS v FROM actual WHERE person_id = 7 GROUP BY 1) USING (m))""",
)
def _(r):
    """One person's months; choosing the person is the question, and the filter reaches the scan."""
    rows = running_total(monthly(r.actual.where(F.col("person_id") == 7), "actual_date", "amount", "actual"), "month", ["actual"])
    return rows.select("month", money("actual", "actual"), money("actual_running", "accumulated"))


@query("hot_deal_count", "SELECT count(*) FILTER (priority = '1-URGENT' AND status = 'Open') AS hot_deals FROM deal_core")
def _(r):
    return r.deal_core.agg(F.count_if((F.col("priority") == "1-URGENT") & has_status("Open")).alias("hot_deals"))


@query(
    "top5_deals_owner",
    top_sql("d", "plan_amount", 5, f"deal_name, person, {sql_money('plan_amount', 'plan')}"),
    d="  SELECT * FROM deal",
)
def _(r):
    """The five deals are found in the deals alone; the owner is looked up for them only."""
    best = topn(r.deal_core.select("deal_id", "deal_name", "plan_amount"), "plan_amount", 5)
    lines = r.table("lineitem").select(F.col("l_orderkey").alias("deal_id"), F.col("l_suppkey"))
    owner = lines.join(best.select("deal_id"), "deal_id", "left_semi").groupBy("deal_id").agg(F.min("l_suppkey").alias("person_id"))
    return best.join(owner, "deal_id", "left").join(r.salesperson.select("person_id", "person"), "person_id", "left").select(
        "deal_name", "person", money("plan_amount", "plan")
    )


@query(
    "won_by_person_ytd",
    f"SELECT person, {sql_money('sum(plan_amount)', 'won')} FROM deal WHERE status = 'Won' AND created {YTD_SQL} GROUP BY 1",
)
def _(r):
    won = r.deal.where(has_status("Won") & in_year_to_date(F.col("created_at"), AS_OF))
    return won.groupBy("person").agg(money(F.sum("plan_amount"), "won"))


# ---- Top-n and listings ----------------------------------------------------------------


@query("topn", top_sql("part", "p_retailprice", 25, "p_partkey, p_retailprice"))
def _(r):
    return topn(r.table("part").select("p_partkey", "p_retailprice"), "p_retailprice", 25)


@query(
    "topn_per",
    """
SELECT status, deal_id, CAST(possibility AS BIGINT) AS possibility FROM (
  SELECT *, rank() OVER (PARTITION BY status ORDER BY plan_amount DESC) AS rk FROM deal_core) WHERE rk <= 20""",
)
def _(r):
    return topn_per(r.deal_core, ["status"], "plan_amount", 20).select("status", "deal_id", whole("possibility", "possibility"))


@query("order_by", f"SELECT deal_id, {sql_money('plan_amount', 'plan')} FROM deal_core ORDER BY plan_amount DESC, deal_id")
def _(r):
    return r.deal_core.orderBy(F.col("plan_amount").desc(), "deal_id").select("deal_id", money("plan_amount", "plan"))


@query(
    "top_contributors",
    """
SELECT account_name AS name, CAST(NULL AS VARCHAR) AS account_id, CAST(NULL AS VARCHAR) AS name_source, won AS value,
       'won_amount' AS measure, false AS is_aggregate_only
FROM (SELECT account_name, CAST(round(sum(plan_amount), 2) AS DOUBLE) AS won FROM deal_core JOIN account USING (account_id) WHERE status = 'Won' GROUP BY 1)
ORDER BY won DESC, account_name LIMIT 5""",
)
def _(r):
    won = r.deal_core.where(F.col("status") == "Won").join(r.account.select("account_id", "account_name"), "account_id")
    return top_contributors(won.groupBy("account_name").agg(money(F.sum("plan_amount"), "won_amount")), 5)


@query(
    "row_cap",
    f"""
SELECT deal_id, {sql_money('plan_amount', 'plan')}, CAST(50 AS BIGINT) AS shown, (SELECT count(*) FROM deal_core WHERE status = 'Open') AS total
FROM deal_core WHERE status = 'Open' ORDER BY plan_amount DESC, deal_id LIMIT 50""",
)
def _(r):
    rows = r.deal_core.where(has_status("Open")).select("deal_id", "plan_amount")
    return row_cap(rows, [F.col("plan_amount").desc(), F.col("deal_id")], 50).select("deal_id", money("plan_amount", "plan"), "shown", "total")


@query(
    "md_row_table",
    """
SELECT '| industry | deals | plan_amount |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
       string_agg('| ' || industry || ' | ' || format('{:,}', deals) || ' | ' || format('{:,.2f}', plan) || ' |', chr(10) ORDER BY industry) AS markdown
FROM (SELECT industry, count(*) AS deals, CAST(round(sum(plan_amount), 2) AS DOUBLE) AS plan FROM deal_core JOIN account USING (account_id) GROUP BY 1)""",
)
def _(r):
    rows = r.deal_core.join(r.account.select("account_id", "industry"), "account_id").groupBy("industry").agg(
        F.count(F.lit(1)).alias("deals"), money(F.sum("plan_amount"), "plan_amount")
    )
    return md_row_table(rows, ["industry"])


@query(
    "aging_days",
    """
SELECT CASE WHEN aging_days <= 30 THEN '0-30' WHEN aging_days <= 60 THEN '31-60' WHEN aging_days <= 90 THEN '61-90' ELSE '>90' END AS bucket,
       count(*) AS deals, CAST(sum(aging_days) AS BIGINT) AS days
FROM deal_core WHERE status = 'Open' GROUP BY 1""",
)
def _(r):
    open_deals = r.deal_core.where(has_status("Open"))
    return open_deals.groupBy(aging_bucket(F.col("aging_days")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("deals"), F.sum("aging_days").cast("bigint").alias("days")
    )
