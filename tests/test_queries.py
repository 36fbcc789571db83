"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as contract
from salesloom.check import compare, open_duckdb
from salesloom.plans import load_all
from salesloom.session import shared_dir

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()


def run(spark, con, name):
    """What is wrong with one query: an empty list when its rows and plan are right."""
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # no pairs of everything, no row-at-a-time Python
    problems = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if op in plan]
    if name in ORACLES:
        return problems + [p for p in compare(df, con.cursor(), ORACLES[name]) if p != "no rows"]
    return problems if df.count() else [*problems, "no rows"]


@pytest.fixture(scope="module")
def results(spark):
    """All queries, several at a time: on tiny tables most of the time is planning."""
    con = open_duckdb(SF)
    shared_dir(spark, "first")
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, spark, con, name) for name in sorted(QUERIES)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(results, name):
    assert results[name].result() == []


def test_entry(spark):
    assert contract.entry(spark).columns == ["account_name", "deal_name", "pipeline"]
