"""Every registered query against its SQL, and rules every plan must follow."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: found.run for name, found in entry.REGISTRY.items()}
SQL = {name: found.sql for name, found in entry.REGISTRY.items()}


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, tables, name):
    assert compare(spark, tables, SF_DIR, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"metric_stream"}))
def test_plan_has_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry_gives_pairs(spark):
    assert entry.entry(spark).count() == 40


@pytest.mark.parametrize("name", ["win_prob_matrix", "mean_win_rate", "total_loss", "loss_grid"])
def test_scans_read_only_used_columns(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert "text" not in schema and "l_extendedprice" not in schema


def test_slice_reaches_the_scan(spark):
    plan = QUERIES["shard_slice"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(page_id,30)" in plan and "LessThan(page_id,60)" in plan
