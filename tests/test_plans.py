"""Plan shapes that must hold for every query."""

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(entry.queries()))
def test_no_cross_product(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["e1_run_changes"]
    assert plan(spark, SF_DIR).columns[:2] == ["scene_id", "n"]
    listed = entry.queries()["n9_classify_errors"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in listed


@pytest.mark.parametrize("name", ["j4_translate", "j5_category_label", "n8_resolve_model", "n8_resolve_model_strict"])
def test_small_dimensions_are_broadcast(spark, name):
    """Lookups neither shuffle nor sort the table they are made for."""
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_larger_plans_broadcast_their_dimensions(spark):
    for name in ("s9_report_rows", "x3_interpolate"):
        plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "LocalTableScan" in plan and plan.count("BroadcastHashJoin") >= 2
