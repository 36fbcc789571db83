"""The registered queries against their SQL on the smallest tables, and the pipeline's stages."""

import pytest

import corpus_pipeline
from salesloom.check import compare, open_duckdb
from salesloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), open_duckdb(SF), ORACLES[name]) == []


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
    assert "contaminated" not in docs.columns
    mix = stage_rows(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    assert len(mix) == docs.count()


def stage_rows(df):
    return df.collect()


def test_stages_accept_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
