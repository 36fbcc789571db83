import datetime as dt
import random

from pyspark.sql import functions as F

from salesloom.operators import finance as fin
from salesloom.operators.measures import drill_across, measure_by
from salesloom.operators.rank import md_row_table, row_cap, top_contributors, topn

AS_OF = dt.date(2026, 5, 15)


def deals(spark):
    """All cells text, as the source delivers them, some of them unreadable."""
    return spark.createDataFrame(
        [("N", "Open", "1,000.50", "20", "100", "2026-05-01"), ("N", "Open", "abc", "", "", "2026-06-01"), ("N", "Won", "10", "80", "x", "2025-01-01"),
         ("N", "Cancelled", "", "40", "5", "2026-01-02"), (None, "Lost", "7", "bad", "95", "2026-02-01")],
        "region string, status string, plan_amount string, possibility string, aging_days string, created string",
    ).withColumn("created", F.col("created").cast("date")).withColumn("actual_amount", F.when(F.col("status") == "Won", "9.5").otherwise("bad"))


def test_text_numbers_and_defaults(spark):
    names = ["total_plan", "total_actual", "opp_count", "won_count", "lost_count", "open_count", "win_rate", "avg_possibility",
             "low_probability", "at_risk", "avg_aging", "max_aging", "stale"]
    got = {r.region: r for r in measure_by({"deal": deals(spark)}, names, ["region"], AS_OF).collect()}
    n = got["N"]
    assert float(n.total_plan) == 1010.5 and float(n.total_actual) == 9.5 and n.opp_count == 4
    assert (n.won_count, n.lost_count, n.open_count) == (1, 1, 2) and n.win_rate == 0.5
    assert abs(n.avg_possibility - 140 / 3) < 1e-9  # unreadable is left out of this mean
    assert n.low_probability == 1 and n.at_risk == 1  # unreadable counts as 100 here
    assert n.avg_aging == 50.0 and n.max_aging == 100 and n.stale == 1  # and as 0 here
    assert got[None].lost_count == 1  # a missing key is a group of its own


def test_year_to_date_and_missing_sides(spark):
    rows = measure_by({"deal": deals(spark)}, "opp_count", ["region"], AS_OF, year_to_date=True).collect()
    assert {r.region: r.opp_count for r in rows} == {"N": 2, None: 1}
    actual = spark.createDataFrame([("p1", 10.0), (None, 2.0)], "person_id string, amount double")
    target = spark.createDataFrame([("p2", 5.0), (None, 4.0)], "person_id string, target_amount double")
    got = measure_by({"actual": actual, "target": target}, ["actual", "target", "achievement", "target_variance"], ["person_id"]).collect()
    got = {r.person_id: (r.actual, r.target, r.achievement, r.target_variance) for r in got}
    assert got == {"p1": (10.0, None, 0.0, 10.0), "p2": (None, 5.0, 0.0, -5.0), None: (2.0, 4.0, 0.5, -2.0)}


def test_drill_across_of_totals(spark):
    a = spark.range(3).agg(F.sum("id").alias("a"))
    b = spark.range(4).agg(F.max("id").alias("b"))
    assert drill_across({"a": a, "b": b}, []).first() == (3, 3)


def test_top_n_keeps_ties_and_drops_blanks(spark, rows):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 4), ("d", 4), ("e", 1), ("f", None)], "k string, v int")
    assert [r[0] for r in rows(topn(df, "v", 2), "k")] == ["a", "b", "c", "d"]
    assert topn(df, "v", 2, ties=False).count() == 2
    assert topn(df, "v", 50).count() == 5


def test_citation(spark, rows):
    df = spark.createDataFrame([(f"a{i}", float(i)) for i in range(10)], "`Account ID` string, Won_Amount double")
    out = top_contributors(df)
    assert [r.value for r in out.orderBy(F.col("value").desc()).collect()] == [9.0, 8.0, 7.0, 6.0, 5.0]
    assert out.first().measure == "Won_Amount"
    guid = "0" * 8 + "-1111-2222-3333-" + "4" * 12
    lookup = spark.createDataFrame([(guid, "Acme", "dim")], "id string, name string, source string")
    known = spark.createDataFrame([(guid, 1.0), ("5" + guid[1:], 2.0)], "account string, v double")
    assert rows(top_contributors(known, lookup=lookup), "name", "account_id", "name_source") == [
        ("5" + guid[1:], None, None), ("Acme", guid, "dim")]
    scalar = spark.createDataFrame([(0.234,)], "Margin double")
    assert top_contributors(scalar).first().asDict() == {"value": 0.234, "measure": "Margin", "is_aggregate_only": True}
    assert top_contributors(scalar.unionAll(scalar)).first().value is None


def test_listing(spark):
    df = spark.range(60).select("id", (F.col("id") * 1.5).alias("amount"))
    assert row_cap(df, [F.col("id")], 50).select("shown", "total").distinct().first() == (50, 60)
    text = md_row_table(df, ["id"], 2).first().markdown
    assert text == "| id | amount |\n| --- | --- |\n| 0 | 0.00 |\n| 1 | 1.50 |\n\n_(showing 2 of 60 rows)_"
    assert md_row_table(df.where("id < 0"), ["id"]).first().markdown == ""


# ---- Finance ---------------------------------------------------------------------------


def test_moves_keep_the_total(spark, rows):
    income = spark.createDataFrame(
        [("Soft", "S", "x Mainframe", 10.0), ("Base", "S", "mainframe", 5.0), ("", "S", "Mainframe", 3.0), ("(Blank)", "M", "Comet", 2.0), ("Firm", "M", "plain", 1.0)],
        "department string, solution string, label string, amount double")
    test = (F.col("solution") == "S") & F.lower("label").contains("mainframe")
    moves = [fin.Move(test, to="Base", source="Soft"), fin.Move(F.col("label") == "Comet", to="Firm", source="Base")]
    got = dict(rows(fin.revenue(income, moves)))
    # every matching row moves, whatever department it has
    assert got == {"Soft": 10 - 18.0, "Base": 5 + 18 - 2.0, "Firm": 1 + 2.0}
    assert sum(got.values()) == fin.revenue(income, moves, total=True).first()[0] == 16.0


def test_project_cost_detail_and_total(spark, rows):
    expense = spark.createDataFrame(
        [("Soft", "P1", "a", 1.0), ("Time", " ", "a", 2.0), ("", "(Blank)", "a", 4.0), ("Time", "P9", "bank", 8.0), ("Time", "P9", "other", 16.0), ("", "P2", "a", 32.0), ("Firm", "P3", "a", 0.004)],
        "department string, project_code string, label string, amount double")
    moves = [fin.Move((F.col("project_code") == "P9") & (F.col("label") == "bank"), to="Soft"), fin.Move((F.col("project_code") == "P9") & (F.col("label") != "bank"), to="Time")]
    detail = dict(rows(fin.project_cost(expense, "Head", moves)))
    assert detail == {"Soft": 1 + 8.0, "Time": 8 + 16 + 16.0, "Head": 6.0, "Firm": None}
    total = fin.project_cost(expense, "Head", moves, total=True).first()[0]
    assert abs(total - (1 + 24 + 0.004 + 6)) < 1e-9


def test_cost_until_the_quit_date(spark, rows):
    cost = spark.createDataFrame(
        [("a", dt.date(2026, 1, d), "X", dt.date(2026, 1, 2), 1.0) for d in (1, 2, 3)] + [("b", dt.date(2026, 1, 3), "X", None, 5.0), ("c", dt.date(2026, 1, 3), "", None, 9.0)],
        "person_id string, day date, department string, quit_date date, cost double")
    assert rows(fin.man_cost(cost)) == [("X", 7.0)]


def test_open_ends_and_reversed_spans(spark, rows):
    d = dt.date
    spans = spark.createDataFrame(
        [("a", d(2026, 1, 30), d(2026, 3, 1)), ("b", None, d(2026, 1, 5)), ("c", d(2026, 3, 30), None), ("d", d(2026, 2, 2), d(2026, 2, 1))],
        "k string, s date, f date")
    want = [("a", d(2026, 1, 1), 2), ("a", d(2026, 2, 1), 28), ("a", d(2026, 3, 1), 1), ("b", d(2026, 1, 1), 5), ("c", d(2026, 3, 1), 2)]
    assert rows(fin.span_months(spans, ["k"], "s", "f", None, d(2026, 1, 1), d(2026, 3, 31)), "k", "month", "days") == want
    far = spark.createDataFrame([("a", d(1971, 5, 20), d(1971, 7, 2)), ("a", d(1971, 6, 1), None), ("b", None, d(1971, 5, 30)), ("c", d(2031, 1, 1), d(2031, 1, 1))], "k string, s date, f date")
    got = {(r.k, r.month): (r.spans, r.days) for r in fin.span_months(far, ["k"], "s", "f").collect()}
    assert got["a", d(1971, 5, 1)] == (1, 12) and got["a", d(1971, 6, 1)] == (2, 60) and got["a", d(1971, 7, 1)] == (2, 33)
    assert got["a", d(2031, 1, 1)] == (1, 1) and got["a", d(2000, 2, 1)] == (1, 29) and len(got) == 717 + 1 + 1
    assert got["b", d(1971, 5, 1)] == (1, 11)
    assert fin.span_months(far.limit(0), ["k"], "s", "f").count() == 0


def test_percent_days_equals_day_by_day(spark):
    rng, low = random.Random(3), dt.date(2025, 1, 1)
    high = dt.date(2025, 12, 31)
    spans = []
    for _ in range(200):
        a, b = (low + dt.timedelta(days=rng.randint(-20, 400)) for _ in range(2))
        spans.append((rng.choice("pq"), rng.choice("xy"), rng.randint(0, 100), None if rng.random() < 0.1 else a, None if rng.random() < 0.1 else b))
    expected = {}
    for person, kind, pct, a, b in spans:
        a, b = a or low, b or high
        if a > b:
            continue
        day = max(a, low)
        while day <= min(b, high):
            key = (person, kind, day.replace(day=1))
            expected[key] = expected.get(key, 0) + pct
            day += dt.timedelta(days=1)
    df = spark.createDataFrame(spans, "person_id string, allocate_type string, assign_percent int, start_date date, finish_date date")
    got = {(r.person_id, r.allocate_type, r.month): r.percent_days for r in fin.percent_days(df, low, high).collect()}
    assert got == {k: x for k, x in expected.items() if x}


def test_idle_share(spark):
    d = dt.date
    cost = spark.createDataFrame([("a", d(2026, 1, 9), "X", None, 310.0), ("b", d(2026, 1, 9), "X", None, 100.0), ("c", d(2026, 1, 9), "X", None, 50.0)],
                                 "person_id string, day date, department string, quit_date date, cost double")
    allocation = spark.createDataFrame(
        [("a", "Work", 50, d(2026, 1, 1), d(2026, 1, 31)), ("b", "Work", 80, None, None), ("b", "Other", 80, None, None), ("a", "Work", 9, d(2026, 1, 9), d(2026, 1, 8))],
        "person_id string, allocate_type string, assign_percent int, start_date date, finish_date date")
    got = {r.allocate_type: round(r.man_cost, 6) for r in fin.man_cost_with_idle(cost, allocation, d(2026, 1, 1), d(2026, 1, 31)).collect()}
    # over-allocated people are never idle, the total is the full cost, not the sum
    assert got == {"Work": 155 + 80.0, "Other": 80.0, "Idle": 155 + 50.0, None: 460.0}


def test_profit_texts(spark):
    pl = spark.createDataFrame([("A", "Jan", 1500000.0), ("A", "Mar", 1500000.0), ("B", "Jan", -250000.0), ("C", "Feb", 0.0), ("", "Jan", 1.0)], "department string, short_month string, profit double")
    best = {r.department: r.best_month for r in fin.best_month(pl, ["department"]).collect()}
    assert best["A"] == "Mar +1.50M" and best["B"] == "Jan -0.25M" and best["C"] == "Feb 0.00M"
    assert fin.departments_at_risk(pl).first().at_risk == "1 / 4"
    status = {r.department: r.profit_status for r in fin.profit_status(pl.withColumn("profit", F.when(F.col("department") != "C", F.col("profit")))).collect()}
    assert status["A"] == "Profit" and status["B"] == "Loss" and status["C"] is None
