"""Test inputs are made by many tasks, whatever the size of the table they come from."""

from groundshift.operators import raster as R
from groundshift.plans import fixtures as fx


def test_samples_are_made_by_many_tasks_and_blocks_need_no_shuffle(spark, tmp_path):
    keys = [*range(600), 7, None]
    rows = spark.createDataFrame([(k,) for k in keys], "s_suppkey bigint")
    rows.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    pixels = fx.pixels(spark, str(tmp_path))
    assert pixels.rdd.getNumPartitions() >= 3
    assert pixels.count() == len(keys) * fx.RASTER_W * fx.RASTER_H * fx.RASTER_BANDS
    plan = R.to_blocks(pixels, fx.RASTER_BLOCK)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("REPARTITION_BY_NUM") == 1


def test_samples_of_a_block_are_sorted_without_a_comparator_lambda(spark):
    pixels = spark.range(4).selectExpr("0 as scene_id", "'later' as epoch", "0 as band", "int(1 - id % 2) as px", "int(id div 2) as py", "double(id) as v")
    made = R.to_blocks(pixels, 2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
    assert [list(r.v) for r in made.collect()] == [[1.0, 0.0, 3.0, 2.0]]
