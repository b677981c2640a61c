"""Joins against sides whose rows come from explodes or Python steps are never broadcast on an estimate."""

import pytest
from pyspark.sql import functions as F

from groundshift.operators.detector import detect_stored
from groundshift.operators.frames import explode_tiles
from groundshift.operators.geometry import map_to_global
from groundshift.operators.raster import crop, warp


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def frames(spark):
    return spark.range(4).select(F.col("id").alias("scene_id"), *[
        F.lit(v).cast("bigint").alias(n) for n, v in (("tgt_w", 96), ("tgt_h", 96), ("work_w", 96), ("work_h", 96))], F.lit(1).alias("n_bands"))


def blocks(spark):
    return spark.range(4).select(
        F.col("id").alias("scene_id"), F.lit("later").alias("epoch"), F.lit(0).alias("band"), F.lit(0).cast("bigint").alias("by"),
        F.lit(64).alias("bw"), F.lit(64).alias("bh"), F.array_repeat(F.lit(1.0), 4096).alias("v"),
    ).withColumn("bx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))


@pytest.mark.parametrize("step", ["warp", "crop", "map"])
def test_no_broadcast_of_exploded_rows(spark, step):
    shift = F.array(*[F.lit(v) for v in (1.0, 0.0, 3.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0)])
    tiles = explode_tiles(frames(spark), tile_px=40)
    det = spark.range(40).selectExpr("id as det_id", "id % 4 as scene_id", "cast(id % 3 as int) as task_idx", *[f"0.5d as {c}" for c in "xywh"])
    made = {
        "warp": lambda: warp(blocks(spark), frames(spark).withColumn("homography", shift)),
        "crop": lambda: crop(blocks(spark), tiles),
        "map": lambda: map_to_global(det, tiles),
    }[step]()
    assert "Broadcast" not in plan(made)
    assert made.count() > 0


def test_stored_answers_are_not_broadcast(spark, tmp_path):
    tasks = explode_tiles(frames(spark), tile_px=40).select("scene_id", "task_idx")
    kept = ["scene_id", "task_idx"]
    detect_stored(tasks.where("scene_id < 2"), lambda: lambda row: "{}", kept, str(tmp_path / "a"))
    found = detect_stored(tasks, lambda: lambda row: "{}", kept, str(tmp_path / "a"))
    assert "Broadcast" not in plan(found)
    assert found.count() == tasks.count()
