"""What the plans of the hot operators must look like."""

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    df = contract.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_filter_reaches_the_scan(spark):
    assert "EqualTo(o_orderstatus,O)" in plan_of(spark, "top_open_deals")


def test_year_to_date_reaches_the_scan(spark):
    assert "GreaterThanOrEqual(o_orderdate" in plan_of(spark, "m_ytd")


def test_only_needed_columns_are_read(spark):
    plan = plan_of(spark, "status_breakdown")
    assert "o_orderstatus" in plan and "o_custkey" not in plan and "o_comment" not in plan


def test_dedup_limits_groups_before_the_shuffle(spark):
    for name in ("dedup_keep_last", "recent_n", "dedup_keep_first", "topn_per"):
        assert "WindowGroupLimit" in plan_of(spark, name), name


def test_top_n_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "topn")


def test_latest_snapshot_does_not_shuffle_the_rows(spark):
    assert "BroadcastHashJoin" in plan_of(spark, "latest_snapshot")
    assert "Exchange hashpartitioning" not in plan_of(spark, "latest_snapshot")


def test_measures_of_one_fact_share_one_aggregation(spark):
    plan = plan_of(spark, "m_ytd")
    assert plan.count("FileScan parquet [o_") == 1


def test_lens_documents_are_gathered_as_text(spark):
    for name in ("render_solution_doc", "render_industry_doc"):
        assert "rangepartitioning" in plan_of(spark, name), name  # a group lies in many tasks from the start


def test_refresh_reads_the_lines_of_deals_once(spark):
    assert "l_orderkey" not in plan_of(spark, "refresh_corpus")  # they are in the deals that were written before
