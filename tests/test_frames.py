import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from groundshift.operators import frames as FR


def grid_by_hand(cols, rows, cap):
    while cols * rows > cap:
        if cols >= rows and cols > 1:
            cols -= 1
        elif rows > 1:
            rows -= 1
        else:
            break
    return cols, rows


@pytest.mark.parametrize("cap", [0, 1, 3, 7, 16])
def test_grid_cap(spark, cap):
    sizes = [(c * 760 - 5, r * 760 - 5) for c in (1, 2, 4, 5, 10) for r in (1, 3, 7, 40)]
    df = spark.createDataFrame(sizes, "work_w bigint, work_h bigint")
    for r in FR.plan_grid(df, max_tiles=cap).collect():
        want = grid_by_hand(math.ceil(r.work_w / 760), math.ceil(r.work_h / 760), cap)
        assert (r.n_cols, r.n_rows) == want


def test_frame_rounding_and_bounds(spark):
    df = spark.createDataFrame([(2600, 1), (5200, 3), (1, 1), (3001, 1), (1536, 1536)], "width bigint, height bigint")
    rows = FR.fit_inside(FR.working_frame(df, max_dim=2600)).collect()
    assert [(r.work_w, r.work_h) for r in rows] == [(2600, 1), (2600, 2), (1, 1), (2600, 1), (1536, 1536)]
    assert [(r.fit_w, r.fit_h) for r in rows][3] == (3000, 1)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2600), st.integers(1, 2600)), min_size=5, max_size=20))
def test_tiles_cover_the_frame(spark, sizes):
    df = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(sizes)], "scene_id int, work_w bigint, work_h bigint")
    tiles = {}
    for t in FR.explode_tiles(df).collect():
        tiles.setdefault(t.scene_id, []).append(t)
    for i, (w, h) in enumerate(sizes):
        mine = sorted(tiles[i], key=lambda t: t.task_idx)
        assert mine[0].label == "overview" and (mine[0].gx, mine[0].gy, mine[0].gw, mine[0].gh) == (0, 0, 1, 1)
        assert [t.task_idx for t in mine] == list(range(len(mine)))
        rest = mine[1:]
        assert min(t.x0 for t in rest) == 0 and max(t.x0 + t.sw for t in rest) == w
        assert min(t.y0 for t in rest) == 0 and max(t.y0 + t.sh for t in rest) == h
        across = sorted({(t.x0, t.x0 + t.sw) for t in rest})
        assert all(b[0] <= a[1] for a, b in zip(across, across[1:]))
        assert all(t.out_w <= 1100 and t.out_h <= 1100 and min(t.out_w, t.out_h) >= 1 for t in rest)


def test_pairs(spark):
    df = spark.createDataFrame([(1, "earlier", 5), (1, "later", 6), (2, "later", 7), (3, "earlier", 8)],
                               "scene_id int, epoch string, width int")
    pair = FR.pair_scenes(df).collect()
    assert [(p.scene_id, p.earlier.width, p.later.width) for p in pair] == [(1, 5, 6)]
    assert {(r.scene_id, r.epoch) for r in FR.unpaired_scenes(df).collect()} == {(2, "later"), (3, "earlier")}


def test_tiling_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, 10, 10)], "scene_id int, work_w bigint, work_h bigint")
    assert "Exchange" not in FR.explode_tiles(df)._jdf.queryExecution().executedPlan().toString()


def test_frames_without_pixels_do_not_stop_the_others(spark):
    sizes = [(1, 6000, 1), (2, 0, 0), (3, -1, -1), (4, None, 5), (5, 800, 600), (6, 1, 1)]
    frames = FR.working_frame(spark.createDataFrame(sizes, "scene_id int, width bigint, height bigint"))
    reasons = {r.scene_id: r.reject_reason for r in FR.split_frames(frames).collect()}
    tiled = {r.scene_id for r in FR.explode_tiles(frames).collect()}
    assert {s for s, r in reasons.items() if r is None} == tiled == {5, 6}


def test_rejected_and_surplus_images(spark):
    rows = [(1, "earlier", 10, 1, None), (1, "earlier", 7, 2, None), (1, "later", 9, 1, None),
            (2, "earlier", -1, 1, "broken"), (2, "later", 5, 1, None)]
    images = spark.createDataFrame(rows, "scene_id int, epoch string, width int, modificationTime int, reject_reason string")
    assert [(r.scene_id, r.earlier.width) for r in FR.pair_scenes(images).collect()] == [(1, 7)]
    assert [tuple(r) for r in FR.surplus_images(images).collect()] == [(1, "earlier", 2)]
    assert [(r.scene_id, r.epoch) for r in FR.unpaired_scenes(images).collect()] == [(2, "later")]
