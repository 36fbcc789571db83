"""Filters and predicates."""

from __future__ import annotations


from pyspark.sql import functions as F

from salesloom.functions.dates import in_month, in_year
from salesloom.functions.values import blank_to_null, contains_any
from salesloom.plans.registry import query
from salesloom.plans.shapes import money, sql_money, whole
from salesloom.sources.roles import AS_OF, has_status


@query("filter_eq", "SELECT account_id, account_name FROM account WHERE industry = 'MACHINERY'")
def _(r):
    return r.account.where(F.col("industry") == "MACHINERY").select("account_id", "account_name")


@query("filter_nonempty_key", "SELECT deal_id, solution, person FROM deal WHERE trim(solution) <> '' AND trim(person) <> ''")
def _(r):
    named = (F.trim("solution") != "") & (F.trim("person") != "")
    return r.deal.where(named).select("deal_id", "solution", "person")


@query("filter_object_type", "SELECT event_id, user_id FROM events WHERE event_type = 'view'")
def _(r):
    return r.table("events").where(F.col("event_type") == "view").select("event_id", "user_id")


@query("filter_empty_body", "SELECT note_id, account_id FROM note WHERE trim(body) <> ''")
def _(r):
    return r.note.where(F.trim("body") != "").select("note_id", "account_id")


@query("filter_status_in", "SELECT deal_id, status FROM deal_core WHERE status IN ('Won', 'Lost')")
def _(r):
    return r.deal_core.where(has_status("Won", "Lost")).select("deal_id", "status")


@query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%hot%'")
def _(r):
    return r.table("part").where(contains_any(F.col("p_name"), ["RING", "Hot"])).select("p_partkey", "p_name")


@query("filter_partial_name", "SELECT person_id, person FROM salesperson WHERE instr(lower(person), lower('#00000001')) > 0")
def _(r):
    found = F.instr(F.lower("person"), "#00000001".lower()) > 0
    return r.salesperson.where(found).select("person_id", "person")


@query(
    "filter_treatas",
    f"""
SELECT person_id, {sql_money('sum(amount)', 'actual')} FROM actual
WHERE year(actual_date) IN (1997, 1999) GROUP BY person_id""",
)
def _(r):
    """A value set on the date dimension reaches the fact through a semi join on the dimension's keys."""
    calendar = r.actual.select("actual_date").distinct()
    chosen = calendar.where(F.year("actual_date").isin(1997, 1999))
    rows = r.actual.join(chosen, "actual_date", "left_semi")
    return rows.groupBy("person_id").agg(money(F.sum("amount"), "actual"))


@query(
    "filter_nonblank_group",
    f"""
SELECT department, {sql_money('sum(amount)', 'amount')} FROM income
WHERE trim(department) <> '' AND department <> '(Blank)' GROUP BY department""",
)
def _(r):
    known = r.income.where(blank_to_null(F.col("department")).isNotNull())
    return known.groupBy("department").agg(money(F.sum("amount"), "amount"))


@query(
    "filter_column_compare",
    "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_partkey < l_orderkey",
)
def _(r):
    return r.table("lineitem").where(F.col("l_partkey") < F.col("l_orderkey")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query(
    "having",
    "SELECT account_id, count(*) AS closed FROM deal_core WHERE status IN ('Won','Lost') GROUP BY 1 HAVING count(*) >= 3",
)
def _(r):
    closed = r.deal_core.where(has_status("Won", "Lost")).groupBy("account_id").agg(F.count(F.lit(1)).alias("closed"))
    return closed.where("closed >= 3")


@query(
    "filter_period",
    f"""
SELECT 'year' AS period, count(*) AS deals, {sql_money('sum(plan_amount)', 'plan')} FROM deal_core WHERE year(created) = 2001
UNION ALL
SELECT 'month', count(*), CAST(round(sum(plan_amount), 2) AS DOUBLE) FROM deal_core WHERE year(created) = 2001 AND month(created) = 5""",
)
def _(r):
    def total(label, test):
        return r.deal_core.where(test).agg(
            F.lit(label).alias("period"), F.count(F.lit(1)).alias("deals"), money(F.sum("plan_amount"), "plan")
        )

    created = F.col("created_at")
    return total("year", in_year(created, AS_OF.year)).unionByName(total("month", in_month(created, AS_OF.year, 5)))


@query(
    "filter_remove",
    f"""
SELECT industry, status, {sql_money('sum(plan_amount)', 'plan')},
       CAST(round(sum(sum(plan_amount)) OVER (PARTITION BY industry), 2) AS DOUBLE) AS plan_any_status
FROM deal_core JOIN account USING (account_id) GROUP BY industry, status""",
)
def _(r):
    """The measure with the status filter removed: summed over the few aggregated rows of the group."""
    from pyspark.sql import Window

    rows = r.deal_core.join(r.account.select("account_id", "industry"), "account_id")
    grouped = rows.groupBy("industry", "status").agg(F.sum("plan_amount").alias("_plan"))
    return grouped.select(
        "industry", "status", money("_plan", "plan"), money(F.sum("_plan").over(Window.partitionBy("industry")), "plan_any_status")
    )


@query(
    "filter_keep",
    "SELECT deal_id, CAST(possibility AS BIGINT) AS possibility FROM deal_core WHERE status IN ('Won','Open') AND status IN ('Open','Lost') AND possibility >= 50",
)
def _(r):
    """An inner filter narrows the outer one instead of replacing it."""
    outer = F.col("status").isin("Won", "Open")
    inner = F.col("status").isin("Open", "Lost") & (F.col("possibility") >= 50)
    return r.deal_core.where(outer & inner).select("deal_id", whole("possibility", "possibility"))


@query("derive_constant", "SELECT page_id AS note_id, '1' AS object_type_code FROM pages")
def _(r):
    return r.note.select("note_id", F.lit("1").alias("object_type_code"))
