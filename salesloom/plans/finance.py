"""Finance measures: revenue, cost, profit and what is read off them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from salesloom.functions.dates import in_year_to_date
from salesloom.operators import finance as fin
from salesloom.operators.rank import topn
from salesloom.plans.registry import query
from salesloom.plans.role_sql import AS_OF_SQL
from salesloom.plans.shapes import money, rate, sql_money, sql_rate
from salesloom.sources.roles import AS_OF


def _has(name: str, text: str):
    return F.coalesce(F.lower(F.col(name)).contains(text.lower()), F.lit(False))


def revenue_moves():
    """Who gets which deals: two rules from one department to another, one onwards."""
    small, promo = F.col("solution") == "SMALL", F.col("solution") == "PROMO"
    return [
        fin.Move(F.coalesce(small & _has("deal_label", "red"), F.lit(False)), to="AFRICA", source="AMERICA"),
        fin.Move(F.coalesce(small & _has("deal_label", "ring"), F.lit(False)), to="AFRICA", source="AMERICA"),
        fin.Move(F.coalesce(promo & _has("deal_label", "hot"), F.lit(False)), to="ASIA", source="AFRICA"),
    ]


def cost_moves():
    """One code split by deal name, and every code that contains a text."""
    one = F.col("project_code") == "Brand#2"
    named = _has("deal_label", "ring") | _has("deal_label", "bolt")
    return [
        fin.Move(one & named, to="AMERICA"),
        fin.Move(one & ~named, to="EUROPE"),
        fin.Move(_has("project_code", "#1"), to="AFRICA"),
    ]


BLANK_TO = "MIDDLE EAST"

REVENUE_SQL = """
  SELECT department, day, amount FROM income WHERE department <> ''
  UNION ALL SELECT 'AFRICA', day, amount FROM income WHERE solution = 'SMALL' AND deal_label LIKE '%red%'
  UNION ALL SELECT 'AMERICA', day, -amount FROM income WHERE solution = 'SMALL' AND deal_label LIKE '%red%'
  UNION ALL SELECT 'AFRICA', day, amount FROM income WHERE solution = 'SMALL' AND deal_label LIKE '%ring%'
  UNION ALL SELECT 'AMERICA', day, -amount FROM income WHERE solution = 'SMALL' AND deal_label LIKE '%ring%'
  UNION ALL SELECT 'ASIA', day, amount FROM income WHERE solution = 'PROMO' AND deal_label LIKE '%hot%'
  UNION ALL SELECT 'AFRICA', day, -amount FROM income WHERE solution = 'PROMO' AND deal_label LIKE '%hot%'"""
MAN_SQL = """
  SELECT department, day, cost FROM employee_cost WHERE department <> '' AND (quit_date IS NULL OR day <= quit_date)"""
PROJECT_SQL = """
  SELECT department, day, amount FROM expense WHERE department <> '' AND project_code <> ''
  UNION ALL SELECT 'MIDDLE EAST', day, amount FROM expense WHERE project_code = ''
  UNION ALL SELECT CASE WHEN deal_label LIKE '%ring%' OR deal_label LIKE '%bolt%' THEN 'AMERICA' ELSE 'EUROPE' END, day, amount
            FROM expense WHERE project_code = 'Brand#2'
  UNION ALL SELECT 'AFRICA', day, amount FROM expense WHERE project_code LIKE '%#1%'"""
PROJECT_TOTAL_SQL = "  SELECT day, amount FROM expense WHERE department <> '' OR project_code = ''"
INCOME_TOTAL_SQL = "  SELECT day, amount FROM income WHERE department <> ''"

DETAIL = {"rev": REVENUE_SQL, "man": MAN_SQL, "proj": PROJECT_SQL}
TOTAL = {"rev": INCOME_TOTAL_SQL, "man": MAN_SQL, "proj": PROJECT_TOTAL_SQL}


def pl_sql(keys: str, names: str, where: str = "TRUE") -> str:
    """Profit and loss by ``keys`` (select list) called ``names``."""
    return f"""
  SELECT *, coalesce(profit / nullif(CAST(revenue AS DOUBLE), 0), 0) AS margin FROM (
    SELECT {names}, revenue, man_cost, project_cost, coalesce(man_cost, 0) + coalesce(project_cost, 0) AS expense,
           coalesce(revenue, 0) - coalesce(man_cost, 0) - coalesce(project_cost, 0) AS profit
    FROM (SELECT {keys}, sum(amount) AS revenue FROM rev WHERE {where} GROUP BY ALL)
    FULL JOIN (SELECT {keys}, sum(cost) AS man_cost FROM man WHERE {where} GROUP BY ALL) USING ({names})
    FULL JOIN (SELECT {keys}, nullif(sum(amount), 0) AS project_cost FROM proj WHERE {where} GROUP BY ALL) USING ({names}))"""


YEAR_KEY = "CAST(year(day) AS BIGINT) AS year"
YTD = f"day BETWEEN DATE '2001-01-01' AND {AS_OF_SQL}"
PL_YEAR = {**DETAIL, "pl": pl_sql(f"{YEAR_KEY}, department", "year, department")}
PL_YTD = {**DETAIL, "pl": pl_sql("department", "department", YTD)}
TOTAL_YEAR = {**TOTAL, "pl": pl_sql(YEAR_KEY, "year")}
MONTH_KEYS = f"{YEAR_KEY}, strftime(day, '%b') AS short_month"
TOTAL_MONTH = {**TOTAL, "pl": pl_sql(MONTH_KEYS, "year, short_month")}
TOTAL_YTD = {**TOTAL, "pl": pl_sql("'all' AS scope", "scope", YTD)}


def profit_loss(r, keys=(), total=False, ytd=False):
    """Profit and loss from the roles, with the period columns each fact needs."""

    def prepare(df):
        if ytd:
            df = df.where(in_year_to_date(F.col("at"), AS_OF))
        return (
            df.withColumn("year", F.year("day").cast("bigint"))
            .withColumn("short_month", F.date_format("day", "MMM"))
            .withColumn("scope", F.lit("all"))
        )

    return fin.profit_loss(
        prepare(r.income), prepare(r.employee_cost), prepare(r.expense), revenue_moves(), BLANK_TO, cost_moves(), keys, total
    )


@query("f_revenue", f"SELECT department, {YEAR_KEY}, {sql_money('sum(amount)', 'revenue')} FROM rev GROUP BY ALL", **DETAIL)
def _(r):
    rows = fin.revenue(r.income.withColumn("year", F.year("day").cast("bigint")), revenue_moves(), ["year"])
    return rows.select("department", "year", money("revenue", "revenue"))


@query("f_revenue_total", f"SELECT {YEAR_KEY}, {sql_money('sum(amount)', 'revenue')} FROM rev GROUP BY ALL", **TOTAL)
def _(r):
    rows = fin.revenue(r.income.withColumn("year", F.year("day").cast("bigint")), revenue_moves(), ["year"], total=True)
    return rows.select("year", money("revenue", "revenue"))


@query("reallocate", f"SELECT department, {sql_money('sum(amount)', 'amount')} FROM rev GROUP BY ALL", **DETAIL)
def _(r):
    rows = fin.reallocate(r.income, revenue_moves())
    return rows.groupBy("department").agg(money(F.sum("amount"), "amount"))


@query("f_man_cost", f"SELECT department, {YEAR_KEY}, {sql_money('sum(cost)', 'man_cost')} FROM man GROUP BY ALL", **DETAIL)
def _(r):
    rows = fin.man_cost(r.employee_cost.withColumn("year", F.year("day").cast("bigint")), ["year"])
    return rows.select("department", "year", money("man_cost", "man_cost"))


@query("f_project_cost", f"SELECT department, {YEAR_KEY}, {sql_money('nullif(sum(amount), 0)', 'project_cost')} FROM proj GROUP BY ALL", **DETAIL)
def _(r):
    rows = fin.project_cost(r.expense.withColumn("year", F.year("day").cast("bigint")), BLANK_TO, cost_moves(), ["year"])
    return rows.select("department", "year", money("project_cost", "project_cost"))


@query("f_project_cost_total", f"SELECT {YEAR_KEY}, {sql_money('nullif(sum(amount), 0)', 'project_cost')} FROM proj GROUP BY ALL", **TOTAL)
def _(r):
    rows = fin.project_cost(r.expense.withColumn("year", F.year("day").cast("bigint")), BLANK_TO, cost_moves(), ["year"], total=True)
    return rows.select("year", money("project_cost", "project_cost"))


def _pl_query(key: str, name: str, kind) -> None:
    """One column of the yearly profit and loss by department."""
    shown = sql_money(name, name) if kind is money else sql_rate(name, name)

    @query(key, f"SELECT year, department, {shown} FROM pl", **PL_YEAR)
    def _(r):
        return profit_loss(r, ["year"]).select("year", "department", kind(name, name))


_pl_query("f_expense", "expense", money)
_pl_query("f_profit", "profit", money)
_pl_query("f_margin", "margin", rate)

PL_COLUMNS = ("revenue", "man_cost", "project_cost", "expense", "profit")


@query(
    "f_ytd_set",
    f"SELECT department, {', '.join(sql_money(c, c) for c in PL_COLUMNS)}, {sql_rate('margin', 'margin')} FROM pl",
    **PL_YTD,
)
def _(r):
    rows = profit_loss(r, ytd=True)
    return rows.select("department", *[money(c, c) for c in PL_COLUMNS], rate("margin", "margin"))


@query(
    "f_profit_split",
    """
SELECT year, department, CAST(round(CASE WHEN profit >= 0 THEN profit END, 2) AS DOUBLE) AS profit_positive,
       CAST(round(CASE WHEN profit < 0 THEN profit END, 2) AS DOUBLE) AS profit_negative FROM pl""",
    **PL_YEAR,
)
def _(r):
    rows = fin.profit_split(profit_loss(r, ["year"]))
    return rows.select("year", "department", money("profit_positive", "profit_positive"), money("profit_negative", "profit_negative"))


@query(
    "f_headcount",
    f"""
SELECT {YEAR_KEY}, count(DISTINCT person_id) AS headcount FROM employee_cost WHERE quit_date IS NULL OR day <= quit_date GROUP BY ALL""",
)
def _(r):
    return fin.employed(r.employee_cost).groupBy(F.year("day").cast("bigint").alias("year")).agg(F.countDistinct("person_id").alias("headcount"))


@query(
    "f_profit_status",
    """
SELECT department, CASE WHEN profit >= 0 THEN 'Profit' WHEN profit < 0 THEN 'Loss' END AS profit_status,
       CASE WHEN profit >= 0 THEN '#4ade80' WHEN profit < 0 THEN '#f87171' END AS profit_colour FROM pl""",
    **PL_YTD,
)
def _(r):
    return fin.profit_status(profit_loss(r, ytd=True)).select("department", "profit_status", "profit_colour")


@query(
    "f_departments_at_risk",
    """
SELECT year, count(*) FILTER (profit < 0) || ' / ' || count(*) AS at_risk FROM pl WHERE profit IS NOT NULL GROUP BY year""",
    **PL_YEAR,
)
def _(r):
    return fin.departments_at_risk(profit_loss(r, ["year"]), ["year"])


MILLIONS_SQL = "CASE WHEN {v} > 0 THEN '+' ELSE '' END || CAST(CAST(round({v} / 1000000.0, 2) AS DECIMAL(18,2)) AS VARCHAR) || 'M'"
BEST_SQL = f"""
SELECT year, short_month || ' ' || {MILLIONS_SQL.format(v='profit')} AS best_month FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY profit DESC, short_month DESC) AS rn FROM pl) WHERE rn = 1"""


@query("f_best_month", BEST_SQL, **TOTAL_MONTH)
def _(r):
    return fin.best_month(profit_loss(r, ["year", "short_month"], total=True), ["year"])


@query(
    "f_full_year",
    f"""
SELECT year, short_month, {sql_money('profit', 'profit')}, {MILLIONS_SQL.format(v='sum(profit) OVER (PARTITION BY year)')} AS full_year FROM pl""",
    **TOTAL_MONTH,
)
def _(r):
    """Each month beside its full year: summed over at most twelve rows per year."""
    rows = profit_loss(r, ["year", "short_month"], total=True)
    whole_year = F.sum("profit").over(Window.partitionBy("year"))
    return rows.select("year", "short_month", money("profit", "profit"), fin.millions(whole_year).alias("full_year"))


IDLE = {
    "monthly": """
  SELECT person_id, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(cost) AS DOUBLE) AS cost
  FROM employee_cost WHERE department <> '' AND (quit_date IS NULL OR day <= quit_date) GROUP BY 1, 2""",
    "share": """
  SELECT person_id, allocate_type, month, sum(assign_percent * active_days) / (100.0 * day(last_day(month))) AS pct FROM (
    SELECT person_id, allocate_type, assign_percent, CAST(m AS DATE) AS month,
           date_diff('day', greatest(start_date, CAST(m AS DATE)), least(finish_date, last_day(CAST(m AS DATE)))) + 1 AS active_days
    FROM (SELECT *, unnest(generate_series(date_trunc('month', start_date)::TIMESTAMP, finish_date::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM allocation))
  GROUP BY person_id, allocate_type, month""",
}


@query(
    "f_man_cost_idle",
    """
SELECT allocate_type, round(sum(v), 2) AS man_cost FROM (
  SELECT allocate_type, cost * pct AS v FROM monthly JOIN share USING (person_id, month) WHERE pct > 0
  UNION ALL
  SELECT 'Idle', cost * (1 - coalesce(used, 0)) FROM monthly LEFT JOIN (SELECT person_id, month, sum(pct) AS used FROM share GROUP BY 1, 2) USING (person_id, month)
  WHERE 1 - coalesce(used, 0) > 0
  UNION ALL SELECT NULL, cost FROM monthly) GROUP BY 1""",
    **IDLE,
)
def _(r):
    rows = fin.man_cost_with_idle(r.employee_cost, r.allocation)
    return rows.select("allocate_type", F.round("man_cost", 2).alias("man_cost"))


@query(
    "allocation_share",
    "SELECT person_id, allocate_type, month, round(pct, 6) AS share FROM share WHERE pct <> 0",
    **IDLE,
)
def _(r):
    rows = fin.percent_days(r.allocation)
    share = F.col("percent_days") / (100 * F.day(F.last_day("month")))
    return rows.select("person_id", "allocate_type", "month", F.round(share, 6).alias("share"))


# ---- Worked finance questions ----------------------------------------------------------


@query(
    "yoy_profit",
    f"SELECT year, {sql_money('profit', 'profit')}, CAST(round(lag(profit) OVER (ORDER BY year), 2) AS DOUBLE) AS last_year FROM pl",
    **TOTAL_YEAR,
)
def _(r):
    rows = profit_loss(r, ["year"], total=True)  # one row per year
    return rows.select("year", money("profit", "profit"), money(F.lag("profit").over(Window.orderBy("year")), "last_year"))


@query(
    "riskiest_department",
    f"SELECT department, {sql_rate('margin', 'margin')} FROM pl WHERE margin = (SELECT min(margin) FROM pl)",
    **PL_YTD,
)
def _(r):
    rows = profit_loss(r, ytd=True).withColumn("_risk", -F.col("margin"))
    return topn(rows, "_risk", 1).select("department", rate("margin", "margin"))


@query("best_month", BEST_SQL.replace("row_number()", "rank()"), **TOTAL_MONTH)
def _(r):
    return fin.best_month(profit_loss(r, ["year", "short_month"], total=True), ["year"])


@query("margin_now", f"SELECT {sql_rate('margin', 'margin')} FROM pl", **TOTAL_YTD)
def _(r):
    return profit_loss(r, ["scope"], total=True, ytd=True).select(rate("margin", "margin"))


@query("profit_loss_ytd", f"SELECT {', '.join(sql_money(c, c) for c in ('revenue', 'expense', 'profit'))} FROM pl", **TOTAL_YTD)
def _(r):
    rows = profit_loss(r, ["scope"], total=True, ytd=True)
    return rows.select(*[money(c, c) for c in ("revenue", "expense", "profit")])


@query("margin_by_department", f"SELECT department, {sql_rate('margin', 'margin')} FROM pl", **PL_YTD)
def _(r):
    return profit_loss(r, ytd=True).select("department", rate("margin", "margin"))
