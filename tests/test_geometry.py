import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
from test_dedupe import SCHEMA, iou, make_rows

from groundshift.functions import box, clamp_box, to_pixels
from groundshift.operators import geometry as G
from groundshift.operators.frames import explode_tiles


@pytest.mark.parametrize("threshold,crowded", [(0.1, 3), (0.4, 2048), (0.4, 2), (0.8, 1)])
def test_pairs_match_brute_force(spark, threshold, crowded):
    rows = make_rows(11, 300, spread=0.3)
    rows += [(*r[:2], r[2] + 1000, *r[3:]) for r in rows[:40]]
    got = {}
    for p in G.iou_pairs(spark.createDataFrame(rows, SCHEMA), threshold, crowded).collect():
        a, b = (p.a_x, p.a_y, p.a_w, p.a_h), (p.b_x, p.b_y, p.b_w, p.b_h)
        key = (p.scene_id, p.change_type, a, b)
        assert key not in got and a <= b
        got[key] = p.a_n * p.b_n if a != b else p.a_n * (p.a_n - 1) // 2
    want = {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] == b[0] and a[3] == b[3] and iou(a, b) > threshold:
                key = (a[0], a[3], *sorted([a[5:9], b[5:9]]))
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_spotlight_matches_brute_force(spark):
    rng = random.Random(3)
    boxes = [(s, rng.random(), rng.random(), rng.random() * 0.4, rng.random() * 0.4, rng.random() < 0.6)
             for s in range(3) for _ in range(12)] + [(0, 0.0, 0.0, 1.0, 0.125, True), (1, 0.5, 0.5, 0.0, 0.5, True)]
    points = [(i, i % 3, rng.random(), rng.random()) for i in range(900)] + [(900, 0, 1.0, 1.0), (901, 1, 0.0, 0.0)]
    b = spark.createDataFrame(boxes, "scene_id int, x double, y double, w double, h double, visible boolean")
    p = spark.createDataFrame(points, "id int, scene_id int, px double, py double")
    want = {i for i, s, x, y in points
            if any(v and s == t and bx <= x < bx + w and by <= y < by + h for t, bx, by, w, h, v in boxes)}
    assert {r.id for r in G.lit_points(p, b).collect()} == want
    assert {r.id for r in G.dim_points(p, b).collect()} == {q[0] for q in points} - want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True)), max_size=5),
                min_size=1, max_size=30))
def test_clamped_boxes_stay_in_the_unit_square(spark, arrays):
    df = spark.createDataFrame([(a,) for a in arrays], "a array<double>")
    for r in df.select(clamp_box(F.col("a")).alias("b")).select("b.*").collect():
        assert 0 <= r.x <= 1 and 0 <= r.y <= 1 and 0 <= r.w <= 1 - r.x and 0 <= r.h <= 1 - r.y


def test_mapping_stays_in_the_unit_square(spark):
    frames = spark.createDataFrame([(0, 2600, 1301)], "scene_id int, work_w bigint, work_h bigint")
    tiles = explode_tiles(frames)
    rng = random.Random(5)
    det = spark.createDataFrame(
        [(0, i % 9, i, rng.random(), rng.random(), rng.random(), rng.random()) for i in range(300)],
        "scene_id int, task_idx int, pos int, x double, y double, w double, h double")
    rows = G.map_to_global(det, tiles).collect()
    assert len(rows) == 300
    assert all(0 <= r.x <= 1 and r.x + r.w <= 1 + 1e-12 and 0 <= r.y and r.y + r.h <= 1 + 1e-12 for r in rows)
    whole = {r.pos: r for r in rows if r.task_idx == 0}
    for d in det.where("task_idx = 0 and x + w <= 1 and y + h <= 1").collect():
        r = whole[d.pos]
        assert (r.x, r.y, r.w, r.h) == (d.x, d.y, d.w, d.h)


def test_pixel_boxes_fall_back_to_square(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.25, 0.25, 200, 100), (0.5, 0.5, 0.25, 0.25, 200, 0)],
                               "x double, y double, w double, h double, width int, height int")
    got = df.select(to_pixels(box(), 1000, F.col("width"), F.col("height")).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in got] == [(500, 250, 250, 125), (500, 500, 250, 250)]


@pytest.mark.parametrize("crowded", [3, 40])
def test_spotlight_of_crowded_cells_matches_brute_force(spark, crowded):
    """Most points, and many boxes, in a few small places; also points that share one place."""
    rng = random.Random(4)
    spot = lambda s: (0.31 + rng.random() * 0.01, 0.62 + rng.random() * 0.01)
    points = [(i, 0, *spot(0)) for i in range(1200)] + [(2000 + i, 0, 0.31, 0.62) for i in range(100)]
    points += [(3000 + i, 1, rng.random(), rng.random()) for i in range(300)] + [(4000, 0, 1.0, 1.0), (4001, 0, 0.999999, 0.999999)]
    boxes = [(0, *spot(0), rng.random() * 0.003, rng.random() * 0.003) for _ in range(150)]
    boxes += [(0, 0.305, 0.61, 0.008, 0.02), (0, 0.99, 0.99, 0.01, 0.01), (1, 0.2, 0.2, 0.4, 0.4), (1, 0.25, 0.25, 0.3125, 0.0625)]
    b = spark.createDataFrame(boxes, "scene_id int, x double, y double, w double, h double")
    p = spark.createDataFrame(points, "id int, scene_id int, px double, py double")
    want = {i for i, s, x, y in points if any(s == t and bx <= x < bx + w and by <= y < by + h for t, bx, by, w, h in boxes)}
    assert {r.id for r in G.lit_points(p, b, crowded=crowded).collect()} == want
    assert sorted(r.id for r in G.dim_points(p, b, crowded=crowded).collect()) == sorted({q[0] for q in points} - want)


def test_a_crowded_scene_spreads_over_many_cells(spark):
    """A third of all points in one sixteenth of one scene: they do not stay in the cells of the first level."""
    points = spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") % 500 + 1).alias("scene_id"),
        (F.lit(0.5) + F.rand(1) / 16).alias("px"), (F.lit(0.25) + F.rand(2) / 16).alias("py"),
    ).checkpoint()
    parts = G._pieces(spark.createDataFrame([(0, 0.5, 0.25, 0.55, 0.3)], "scene_id long, x0 double, y0 double, x1 double, y1 double"), 16)
    located = points.select("*", F.floor(F.col("px") * 16).alias("_cx"), F.floor(F.col("py") * 16).alias("_cy"))
    assert G.crowded_cells(located, parts, 500).count() == 1
    finer = G._pieces(parts.select("scene_id", "x0", "y0", "x1", "y1"), 64)
    located = points.select("*", F.floor(F.col("px") * 64).alias("_cx"), F.floor(F.col("py") * 64).alias("_cy"))
    assert finer.where("whole").count() == 9 and G.crowded_cells(located, finer.where("not whole"), 500).count() > 3


def test_pairs_of_a_crowd_spread_over_tasks(spark):
    crowd = spark.range(2000).selectExpr(
        "1L as scene_id", "'new' as change_type", "named_struct('x', 0.5 + id * 1e-7, 'y', 0.5, 'w', 0.1, 'h', 0.1) as b"
    ).select("scene_id", "change_type", "b.*")
    pairs = G.iou_pairs(crowd, 0.5, crowded=50)
    sizes = sorted(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 2000 * 1999 // 2 and sizes[-1] <= 4 * sizes[len(sizes) // 2] and len(sizes) > 1
