"""The steps of run_images on many small scenes: what they give, and that their work does not grow by rows or by scenes where it need not."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundshift.operators import raster as R
from groundshift.operators import registration as REG

PIX = "scene_id int, epoch string, band int, px int, py int, v double"
FRAMES = "scene_id int, tgt_w bigint, tgt_h bigint, work_w bigint, work_h bigint, n_bands int, homography array<double>"


def plain_blocks(rows, size):
    """What to_blocks says it gives, place by place."""
    blocks = {}
    for s, e, b, x, y, v in rows:
        blocks.setdefault((s, e, b, x // size, y // size), []).append((x % size, y % size, v))
    out = {}
    for key, samples in blocks.items():
        w, h = (max(s[i] for s in samples) + 1 for i in (0, 1))
        at = {}
        for x, y, v in samples:
            at.setdefault((y, x), []).append(v)
        once = len(samples) == w * h == len(at)
        rank = lambda v: (-1, 0) if v is None else (1, 0) if np.isnan(v) else (0, v)
        largest = [max(at.get((y, x), [None]), key=rank) for y in range(h) for x in range(w)]
        out[key] = (w, h, largest if once else [float("nan") if v is None else v for v in largest])
    return out


@pytest.mark.parametrize("size", [5, 16, 24, 64])
def test_blocks_equal_a_plain_gathering(spark, size):
    rng = np.random.default_rng(size)
    rows = [(0, "later", b, x, y, float(rng.integers(0, 99))) for b in range(2) for x in range(50) for y in range(35)]
    odd = [(1, "later", 0, x, y, [1.5, None, float("nan"), -3.0][int(rng.integers(4))]) for x in range(40) for y in range(33)]
    twice = [(2, "later", 0, int(x), int(y), [7.0, None, float("nan"), float(v)][int(v) % 4]) for x, y, v in rng.integers(0, 20, (900, 3))]
    rows += odd + [(3, *r[1:]) for r in odd if rng.random() < 0.9] + twice + [(4, "later", 0, 100, 70, 3.0)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    made = R.to_blocks(spark.createDataFrame(rows, PIX).repartition(3, "scene_id"), size)
    got = {(r.scene_id, r.epoch, r.band, r.bx, r.by): (r.bw, r.bh, r.v) for r in made.collect()}
    wanted = plain_blocks(rows, size)
    assert got.keys() == wanted.keys()
    for key, (w, h, v) in wanted.items():
        assert got[key][:2] == (w, h)
        assert [repr(a) for a in got[key][2]] == [repr(a) for a in v]


def test_samples_are_put_together_by_numbers_before_lists_are_made(spark):
    made = R.to_blocks(spark.createDataFrame([(0, "later", 0, 0, 0, 1.0)], PIX), 16)
    plan = made._jdf.queryExecution().executedPlan().toString()
    lists = [line for line in plan.splitlines() if "partial_collect_list" in line]
    assert lists and all("_run" in line for line in lists) and "bit_or" in plan


def test_maps_without_perspective_reach_no_block_that_no_pixel_samples(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    types = "bx bigint, by bigint, bw int, bh int, tgt_w bigint, tgt_h bigint, back array<double>"
    table = [(bx, by, 8, 8, 32, 32, eye) for bx in range(4) for by in range(4)]
    found = spark.createDataFrame(table, types).mapInArrow(R._reach(8), f"{types}, sbx bigint, sby bigint").collect()
    assert [(r.sbx, r.sby) for r in found] == [(r.bx, r.by) for r in found] and len(found) == 16
    # The same holds on the JVM; half a pixel reaches over the border.
    across, down = R._reached(8)
    frames = spark.createDataFrame([(*r[:6], [*eye[:2], s, *eye[3:]]) for r in table for s in (0.0, 0.5)], types)
    for r in frames.select("bx", "by", "back", across.alias("a"), down.alias("d")).collect():
        assert r.a == ([r.bx, r.bx + 1] if r.back[2] and r.bx < 3 else [r.bx]) and r.d == [r.by]


def test_reached_blocks_hold_every_tap_of_affine_maps():
    rng = np.random.default_rng(2)
    size, side, sampled = 8, 64, 0
    for trial in range(300):
        back = rng.normal(0, 1, 9) * [1, 1, 30, 1, 1, 30, 0, 0, 1]
        if trial % 3 == 0:
            back = np.array([2.0 ** -(trial % 4), 0, trial % 7, 0, 1 / (trial + 1), trial % 5 / 3, 0, 0, trial % 2 or 0.3])
        x, y = (int(v) for v in rng.integers(0, 4, 2))
        cols, rows, weights = R._taps(back, x * size, y * size, size, size, side, side)
        used = weights != 0
        needed = set(zip((cols[used] // size).tolist(), (rows[used] // size).tolist()))
        batch = pd.DataFrame({"bx": [x], "by": [y], "bw": [size], "bh": [size], "tgt_w": [side], "tgt_h": [side], "back": [back]})
        batch = pa.RecordBatch.from_pandas(batch, preserve_index=False)
        found = next(R._reach(size)(iter([batch]))).to_pandas()
        assert needed <= set(zip(found["sbx"], found["sby"]))
        sampled += len(needed)
    assert sampled > 300


def test_taps_of_many_blocks_equal_those_of_one():
    rng = np.random.default_rng(5)
    size = 8
    back = np.eye(3).ravel() + rng.normal(0, 1, (200, 9)) * [.2, .1, 3, .1, .2, 3, .01, .01, .1]
    back[::4] = np.round(back[::4])
    x0, y0 = rng.integers(0, 4, (2, 200)) * size
    src_w, src_h, left, top = np.full(200, 29), np.full(200, 19), *rng.integers(0, 3, (2, 200)) * size
    block, pixel, taps = R._block_taps(back, x0, y0, 7, 6, src_w, src_h, left, top, size)
    seen = 0
    for i in range(200):
        cols, rows, weights = R._taps(back[i], x0[i], y0[i], 7, 6, 29, 19)
        cols, rows = cols - left[i], rows - top[i]
        inside = (cols >= 0) & (cols < size) & (rows >= 0) & (rows < size) & (weights != 0)
        mine = block == i
        assert (pixel[mine] == np.flatnonzero(inside.any(axis=0))).all()
        for k, (col, line, weight) in enumerate(taps):
            some = weight[mine] != 0
            at = pixel[mine][some]
            assert (at == np.flatnonzero(inside[k])).all()
            assert (weight[mine][some] == weights[k, at]).all() and (col[mine][some] == cols[k, at]).all() and (line[mine][some] == rows[k, at]).all()
            seen += len(at)
    assert seen > 500


def test_shares_of_a_warp_are_added_as_they_come(spark):
    """No list is gathered, groups are cut by Arrow batches and a scene listed twice adds up, with missing bands and blocks."""
    rng = np.random.default_rng(3)
    rows = [(s, "later", b, x, y, float(rng.integers(0, 256))) for s in range(3) for b in range(2) for x in range(21) for y in range(13)
            if (s, b, x // 8) != (1, 1, 1)]
    half = [0.5, 0.0, 0.25, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0]
    frames = spark.createDataFrame([(s, 21, 13, 10, 7, 2, half) for s in (0, 1, 2, 2)], FRAMES)
    made = R.warp(R.to_blocks(spark.createDataFrame(rows, PIX), 8), frames, 8, rounded=False)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(sby" not in plan and "share#" in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.scene_id, r.band, r.px, r.py): r.v for r in R.explode_blocks(made, 8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    values = {r[:1] + r[2:5]: r[5] for r in rows}
    assert len(got) == 3 * 2 * 10 * 7
    for (s, b, x, y), v in got.items():
        sx, sy, total = (x - 0.25) * 2, y * 2, 0.0
        for dx in (0, 1):
            weight = sx - np.floor(sx) if dx else 1 - sx + np.floor(sx)
            total += weight * values.get((s, b, int(np.floor(sx)) + dx, sy), 0.0)
        assert v == pytest.approx(total * (2 if s == 2 else 1))


def test_float_samples_equal_double_ones(spark):
    src = np.arange(24 * 20, dtype=float).reshape(20, 24) * 7 % 251
    blocks = R.to_blocks(spark.createDataFrame([(0, "later", 0, x, y, float(src[y, x])) for x in range(24) for y in range(20)], PIX), 8)
    tiles = spark.createDataFrame(
        [(0, 0, 0, 0, 24, 20, 5, 20), (0, 1, 3, 2, 17, 15, 17, 15)],
        "scene_id int, task_idx int, x0 long, y0 long, sw long, sh long, out_w long, out_h long")
    one, two = ({(r.task_idx, r.bx, r.by): r.v for r in R.crop_scaled(blocks, tiles, 8, sample=k).collect()} for k in ("double", "float"))
    assert one == two and len(one) > 5
    assert R.crop_scaled(blocks, tiles, 8, sample="float").schema["v"].dataType.simpleString() == "array<float>"


def test_small_scenes_are_compared_together():
    rng = np.random.default_rng(7)
    rows = []
    for scene in range(600):
        n, m = (16, 16) if scene % 3 else (int(rng.integers(1, 30)), int(rng.integers(1, 30)))
        q, t = (rng.integers(-2 ** 62, 2 ** 62, (k, 2)) for k in (n, m))
        t[: m // 2] = q[np.arange(m // 2) % n] ^ 1
        place = rng.random((4, 30))
        rows.append((scene, np.arange(n), place[0, :n], place[1, :n], q.ravel(), 7 + 2 * np.arange(m), place[2, :m], place[3, :m], t.ravel()))
    names = ["scene_id", "q_id", "q_x", "q_y", "q_desc", "t_id", "t_x", "t_y", "t_desc"]
    frames = list(REG._nearest_two(iter([pd.DataFrame(rows, columns=names)])))
    assert len(frames) <= 2
    got = {}
    for r in pd.concat(frames).itertuples(index=False):
        got.setdefault((r.scene_id, r.q_id, r.qx, r.qy), []).append((r.d, r.t_id, r.tx, r.ty))
    count = 0
    for scene, q_id, qx, qy, q, t_id, tx, ty, t in rows:
        far = np.bitwise_count((q.reshape(-1, 1, 2) ^ t.reshape(1, -1, 2)).view(np.uint64)).sum(axis=2).tolist()
        for i in range(len(q_id)):
            assert sorted(got[scene, q_id[i], qx[i], qy[i]]) == sorted(zip(far[i], t_id, tx, ty))[:2]
            count += 1
    assert count == len(got)


def test_samples_are_usable_by_their_condition():
    """The bound by the determinant decides as the singular values do, near the limit and without any solution too."""
    rng = np.random.default_rng(11)
    src = rng.random((900, 4, 2)) * 10
    src[:300, 3] = src[:300, 0] + (src[:300, 1] - src[:300, 0]) * 0.5 + 10.0 ** -rng.uniform(0, 16, (300, 1))
    src[300:400, 2] = src[300:400, 1]
    dst = src + rng.random((900, 4, 2))
    eye = np.eye(3)
    with np.errstate(all="ignore"):
        wanted = np.linalg.cond(REG._equations(src, dst)[:, :, :8]) < 1e8
    assert (~np.isnan(REG._solve(src, dst, eye, eye)[:, 0]) == wanted).all() and 0.2 < wanted.mean() < 0.95


def test_few_bytes_of_matches_are_fitted_by_all_cores(spark):
    near = spark.range(16 * 400).select(
        (F.col("id") % 400).cast("int").alias("scene_id"), F.floor(F.col("id") / 400).alias("q_id"), F.floor(F.col("id") / 400).alias("t_id"),
        *[(F.floor(F.col("id") / 400) * k % 31).cast("double").alias(n) for n, k in (("sx", 5), ("sy", 7), ("dx", 5), ("dy", 7))],
        F.lit(16).cast("bigint").alias("match_count"))
    fits = REG.fit_homography(near)
    assert fits.rdd.getNumPartitions() >= 4
    rows = fits.collect()
    assert len(rows) == 400 and all(r.inliers == 16 and np.allclose(r.homography, np.eye(3).ravel(), atol=1e-6) for r in rows)
