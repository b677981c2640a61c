"""Inputs derived from the driver tables by arithmetic that reads the same in Spark and DuckDB.

Every fixture is a list of (expression, name) over one table, so both engines start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.detector import spread_calls
from ..session import configure

Fields = list[tuple[str, str]]

DETECTIONS: Fields = [
    ("o_orderkey", "det_id"),
    ("o_orderkey", "pos"),
    ("cast(floor(o_custkey / 4) as bigint)", "scene_id"),
    ("cast(o_orderkey % 17 as int)", "task_idx"),
    ("case when o_orderkey % 19 = 0 then null"
     " when o_orderkey % 8 = 0 then 'building' when o_orderkey % 8 = 1 then 'house'"
     " when o_orderkey % 8 = 2 then 'road' when o_orderkey % 8 = 3 then 'bridge'"
     " when o_orderkey % 8 = 4 then 'plot' when o_orderkey % 8 = 5 then 'water'"
     " when o_orderkey % 8 = 6 then 'vegetation' else 'silo' end", "category"),
    ("case when o_orderkey % 23 = 0 then 'moved' when o_orderstatus = 'P' then 'added'"
     " when o_orderstatus = 'F' then 'removed' else 'modified' end", "change_type"),
    ("case when o_orderkey % 7 = 0 then concat('Roof_A 50% larger ', cast(o_orderkey as string))"
     " else concat('New Hall ', cast(o_orderkey as string)) end", "description"),
    ("case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high'"
     " when o_orderpriority = '3-MEDIUM' then 'medium'"
     " when o_orderpriority = '4-NOT SPECIFIED' then 'unsure' else 'low' end", "confidence"),
    ("(o_orderkey * 7 % 13) / 16.0e0", "x"),
    ("(o_orderkey * 11 % 13) / 16.0e0", "y"),
    ("least((1 + (o_orderkey * 3) % 8) / 16.0e0, 1 - (o_orderkey * 7 % 13) / 16.0e0)", "w"),
    ("least((1 + (o_orderkey * 5) % 8) / 16.0e0, 1 - (o_orderkey * 11 % 13) / 16.0e0)", "h"),
]

SCENES: Fields = [
    ("p_partkey", "scene_id"),
    ("cast(400 + (p_partkey * 37) % 6000 as bigint)", "width"),
    ("cast(300 + (p_partkey * 53) % 5000 as bigint)", "height"),
    ("cast(p_partkey % 4 as int)", "epoch_mask"),
    ("case when p_partkey % 17 = 3 then null else p_partkey * 1000003 % 300000000 end", "byte_len"),
]

RESPONSES: Fields = [
    ("event_id", "event_id"),
    ("user_id", "scene_id"),
    ("cast(event_id % 12 as int)", "shape"),
    ("case event_id % 12"
     """ when 0 then '{"summary":"s","changes":[{"category":"road","change_type":"added","description":"d","confidence":"high","bbox":[0.25,0.25,0.5,0.5]}]}'"""
     """ when 1 then concat('```json', chr(10), '{"summary":"f","changes":[]}', chr(10), '```')"""
     """ when 2 then '{"summary":"t"} trailing'"""
     " when 3 then 'not json' when 4 then 'null' when 5 then '5'"
     """ when 6 then '{"summary":"o","changes":{"a":1}}'"""
     """ when 7 then '{"summary":"b","changes":[{"category":"house","bbox":"x"},{"category":"plot","bbox":[0.5,"0.25",null,true]}]}'"""
     """ when 8 then '{"changes":[null]}'"""
     """ when 9 then '{"changes":[5,{"change_type":"moved","confidence":"sure","bbox":[-1,2,3,4,9]}]}'"""
     """ when 10 then '{"summary":"n","changes":null}'"""
     " else '' end", "raw_text"),
    ("case when event_type <> 'error' then 200 when event_id % 3 = 0 then 401"
     " when event_id % 3 = 1 then 403 else 500 end", "http_status"),
    ("case when event_type <> 'error' then null when event_id % 2 = 0 then 'invalid x-api-key'"
     " else 'socket hang up' end", "error"),
    ("case when event_id % 5 = 0 then '' else concat('model-', cast(event_id % 3 as string)) end", "model"),
]

# Raster per supplier: 32 x 24 samples in four bands, later epoch.
RASTER_W, RASTER_H, RASTER_BANDS, RASTER_BLOCK = 32, 24, 4, 16
# Scenes whose samples one task makes.
RASTER_SCENES = 256
U16_SAMPLE = "cast((px * 7 + py * 13 + band * 29 + scene_id * 17) * 211 % 65536 as double)"
FLOAT_SAMPLE = (
    "case when (px + py + scene_id) % 50 = 0 then cast('NaN' as double)"
    " else cast((px * 7 + py * 13 + band * 29 + scene_id * 17) * 211 % 65536 as double) / 8 - 2000 end"
)
U8_SAMPLE = "cast((px * 7 + py * 13 + band * 29 + scene_id * 17) % 256 as double)"

# Homography of the keypoint fixture, later to earlier; a mild perspective warp.
HOMOGRAPHY = [1.0625, 0.03125, 4.0, -0.03125, 0.9375, 8.0, 0.0001220703125, 0.00006103515625, 1.0]


# Source to frame, with the horizon across the frame; no pixel lies on it. Its adjugate is exact in doubles.
PERSPECTIVE = [1.0, 1.0, 2.0009765625, 0.03125, 1.0, 1.00048828125, 0.0625, 0.0, -0.625]
# The later date of a registered raster scene shows places this much further left and up.
LATER_SHIFT = (3, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, name: str, fields: Fields) -> DataFrame:
    configure(spark)
    return table(spark, sf_dir, name).selectExpr(*[f"{e} as {a}" for e, a in fields])


def _twin(name: str, fields: Fields) -> str:
    return f"select {', '.join(f'{e} as {a}' for e, a in fields)} from {name}"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "orders", DETECTIONS)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "part", SCENES)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "events", RESPONSES)


DETECTIONS_SQL = _twin("orders", DETECTIONS)
SCENES_SQL = _twin("part", SCENES)
RESPONSES_SQL = _twin("events", RESPONSES)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rows of the scenes by their epoch mask; later images are 64 pixels wider."""
    s = scenes(spark, sf_dir)
    epochs = F.filter(
        F.array(F.when(F.expr("epoch_mask in (1, 3)"), "earlier"), F.when(F.expr("epoch_mask in (2, 3)"), "later")),
        lambda e: e.isNotNull(),
    )
    return s.withColumn("epoch", F.explode(epochs)).select(
        "scene_id", "epoch", F.expr("width + case when epoch = 'later' then 64 else 0 end").alias("width"), "height"
    )


def pixels(spark: SparkSession, sf_dir: str, sample: str = U16_SAMPLE) -> DataFrame:
    configure(spark)
    # A small table of scenes is one task, which would make all samples; spread by scene, blocks also need no shuffle of samples.
    at = spread_calls(
        table(spark, sf_dir, "supplier").selectExpr("s_suppkey as scene_id"), calls_per_task=RASTER_SCENES, keys=["scene_id"])
    for name, count in (("px", RASTER_W), ("py", RASTER_H), ("band", RASTER_BANDS)):
        at = at.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return at.withColumn("epoch", F.lit("later")).withColumn("v", F.expr(sample))


def pixels_sql(sample: str = U16_SAMPLE) -> str:
    return (
        f"select *, {sample} as v from (select *, unnest(range({RASTER_BANDS})) as band from"
        f" (select *, unnest(range({RASTER_H})) as py from"
        f" (select s_suppkey as scene_id, unnest(range({RASTER_W})) as px from supplier)))"
    )


# A second date of the eight-bit rasters: some samples are 9 higher.
EARLIER_U8_SAMPLE = f"({U8_SAMPLE}) + case when (px + scene_id) % 7 = 0 then 9 else 0 end"


def dated_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both dates of the eight-bit rasters."""
    later = pixels(spark, sf_dir, U8_SAMPLE)
    return later.unionByName(pixels(spark, sf_dir, EARLIER_U8_SAMPLE).withColumn("epoch", F.lit("earlier")))


def raster_keypoints(spark: SparkSession, sf_dir: str, shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """Sixteen keypoints in every even raster scene, moved left and up by ``shift``; none in the others."""
    scenes_ = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as scene_id").where("scene_id % 2 = 0")
    return scenes_.withColumn("kp_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint")))).select(
        "scene_id", "kp_id", (F.col("kp_id") * 5 % 31 - shift[0]).cast("double").alias("x"),
        (F.col("kp_id") * 7 % 23 - shift[1]).cast("double").alias("y"),
        F.array(F.xxhash64("kp_id"), F.xxhash64("kp_id", F.lit(1))).alias("desc"),
    )


def raster_pairs(spark: SparkSession, sf_dir: str, work_w: int, work_h: int) -> DataFrame:
    """Frames of the raster scenes: source extent and a working frame."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("scene_id"),
        *[F.lit(v).cast("bigint").alias(n) for n, v in
          (("tgt_w", RASTER_W), ("tgt_h", RASTER_H), ("work_w", work_w), ("work_h", work_h))],
        F.lit(RASTER_BANDS).alias("n_bands"),
    )


def _word(low: int) -> str:
    """Bits low .. low + 31 of the descriptor, one per positive component."""
    return " + ".join(
        f"case when embedding[{i}] > 0 then cast({1 << (i - low)} as bigint) else cast(0 as bigint) end"
        for i in range(low, low + 32)
    )


def keypoints(spark: SparkSession, sf_dir: str, odd: bool = False) -> tuple[DataFrame, DataFrame]:
    """Later and earlier keypoints: same vectors with one bit flipped, positions related by HOMOGRAPHY.

    Every fifth earlier keypoint sits elsewhere. With ``odd``, scene 0 has too few earlier keypoints to register, and all
    later keypoints of scene 1 share one place, so that no fit exists.
    """
    configure(spark)
    later = table(spark, sf_dir, "embeddings").selectExpr(
        "label as scene_id", "vec_id as kp_id",
        *[f"{e} as {n}" for e, n in zip(_places(odd), "xy")],
        f"array({_word(0)}, {_word(32)}) as desc",
    )
    a = HOMOGRAPHY
    depth = f"({a[6]!r}d * x + {a[7]!r}d * y + {a[8]}d)"
    moved = later.where("scene_id <> 0 or kp_id % 100 = 0" if odd else "true").selectExpr(
        "scene_id", "kp_id",
        f"case when kp_id % 5 = 0 then cast(kp_id * 31 % 251 as double) else ({a[0]}d * x + {a[1]}d * y + {a[2]}d) / {depth} end as hx",
        f"case when kp_id % 5 = 0 then cast(kp_id * 43 % 241 as double) else ({a[3]}d * x + {a[4]}d * y + {a[5]}d) / {depth} end as hy",
        "array(case when kp_id % 64 < 32 then desc[0] ^ shiftleft(1L, int(kp_id % 64)) else desc[0] end,"
        " case when kp_id % 64 >= 32 then desc[1] ^ shiftleft(1L, int(kp_id % 64 - 32)) else desc[1] end) as desc",
    ).withColumnsRenamed({"hx": "x", "hy": "y"})
    return later, moved


def _duck_word(low: int) -> str:
    return " + ".join(
        f"case when embedding[{i + 1}] > 0 then {1 << (i - low)}::bigint else 0::bigint end" for i in range(low, low + 32)
    )


def _places(odd: bool) -> list[str]:
    """Positions of the later keypoints."""
    spread = [f"cast(vec_id * {step} % 256 as double)" for step in (17, 29)]
    return [f"case when label = 1 then cast(40 as double) else {p} end" for p in spread] if odd else spread


def keypoints_sql(odd: bool = False) -> str:
    """CTEs ``later`` and ``earlier`` (scene_id, kp_id, x, y, d0, d1)."""
    a = HOMOGRAPHY
    n = [f"cast({v!r} as double)" for v in a]
    depth = f"({n[6]} * x + {n[7]} * y + {n[8]})"
    return f"""
later as (select label as scene_id, vec_id as kp_id, {_places(odd)[0]} as x,
  {_places(odd)[1]} as y, {_duck_word(0)} as d0, {_duck_word(32)} as d1 from embeddings),
earlier as (select scene_id, kp_id,
  case when kp_id % 5 = 0 then cast(kp_id * 31 % 251 as double) else ({n[0]} * x + {n[1]} * y + {n[2]}) / {depth} end as x,
  case when kp_id % 5 = 0 then cast(kp_id * 43 % 241 as double) else ({n[3]} * x + {n[4]} * y + {n[5]}) / {depth} end as y,
  case when kp_id % 64 < 32 then xor(d0, 1::bigint << cast(kp_id % 64 as int)) else d0 end as d0,
  case when kp_id % 64 >= 32 then xor(d1, 1::bigint << cast(kp_id % 64 - 32 as int)) else d1 end as d1
  from later where {"scene_id <> 0 or kp_id % 100 = 0" if odd else "true"})"""
