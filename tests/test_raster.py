import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundshift.operators import raster as R
from groundshift.operators.frames import explode_tiles
from groundshift.sources import images as S

PIX = "scene_id int, epoch string, band int, px int, py int, v double"


def png(samples):
    h, w, _ = samples.shape
    raw = b"".join(b"\x00" + samples[y].tobytes() for y in range(h))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(samples, bits):
    h, w = samples.shape
    body = samples.astype("<u2" if bits == 16 else "u1").tobytes()
    tags = [(256, 3, w), (257, 3, h), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1),
            (278, 3, h), (279, 4, len(body))]
    pad = b"\x00" * (len(body) % 2)
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\x00" * 4
    return struct.pack("<2sHI", b"II", 42, 8 + len(body) + len(pad)) + body + pad + ifd


def test_scan_and_decode(spark, tmp_path):
    rng = np.random.default_rng(1)
    colour = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    grey = rng.integers(0, 256, (4, 6), dtype=np.uint8)
    good = tiff(grey, 8)
    files = {"a.PNG": png(colour), "b.tif": good, "c.TIFF": tiff(grey.astype(int) * 257, 16), "d.tif": good[:20],
             "e.txt": b"text", "f.jpg": b"text", "g": b"x"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    listed = S.scan_images(spark, str(tmp_path), with_content=False).collect()
    assert {r.path.rsplit("/", 1)[1] for r in listed} == {"a.PNG", "b.tif", "c.TIFF", "d.tif", "f.jpg"}
    assert {r.ext for r in listed} == {"png", "tif", "tiff", "jpg"}
    decoded = S.decode_images(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in decoded.collect()}
    assert (rows["a.PNG"].width, rows["a.PNG"].height, rows["a.PNG"].n_channels) == (7, 5, 3)
    assert rows["f.jpg"].reject_reason and rows["d.tif"].reject_reason and not rows["b.tif"].reject_reason
    assert (rows["c.TIFF"].width, rows["c.TIFF"].height) == (6, 4)
    keyed = decoded.withColumn("scene_id", F.lit(1)).withColumn("epoch", F.lit("later")).where("ext = 'png'")
    got = np.zeros((5, 7, 3))
    for r in R.explode_blocks(R.image_blocks(keyed, 4), 4).collect():
        got[r.py, r.px, r.band] = r.v
    assert (got == colour).all()


def test_files_above_the_limit_are_listed_but_never_opened(spark, tmp_path):
    grey = np.arange(24, dtype=np.uint8).reshape(4, 6)
    good = tiff(grey, 8)
    (tmp_path / "good.tif").write_bytes(good)
    (tmp_path / "broken.tif").write_bytes(good[:20])
    large = tmp_path / "large.tif"
    with large.open("wb") as f:
        f.truncate(1000)
    decoded = S.decode_images(spark, str(tmp_path), max_bytes=500)
    # A file that is gone after the listing would fail the job if it were opened.
    large.unlink()
    rows = {r.path.rsplit("/", 1)[1]: r for r in decoded.collect()}
    assert set(rows) == {"good.tif", "broken.tif"} and rows["good.tif"].byte_len == len(good)
    with large.open("wb") as f:
        f.truncate(1000)
    rejected = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in S.rejected_images(spark, str(tmp_path), 500).collect()}
    assert rejected == {"large.tif": "size 1000 exceeds 500 bytes", "broken.tif": "Image could not be decoded"}
    empty = tmp_path / "none"
    empty.mkdir()
    assert S.decode_images(spark, str(empty)).count() == 0 and S.rejected_images(spark, str(empty)).count() == 0


def test_size_guard(spark):
    df = spark.createDataFrame([(None,), (157286400,), (157286401,)], "byte_len bigint")
    got = [r.reject_reason for r in S.split_accepted(df).collect()]
    assert got == ["missing", None, "size 157286401 exceeds 157286400 bytes"]


def raster(spark, samples, size, scene=0):
    """Blocks of an array (rows, columns, bands)."""
    h, w, b = samples.shape
    rows = [(scene, "later", k, x, y, float(samples[y, x, k])) for y in range(h) for x in range(w) for k in range(b)]
    return R.to_blocks(spark.createDataFrame(rows, PIX), size)


def read(blocks, w, h, b, size):
    out = np.full((h, w, b), np.nan)
    for r in R.explode_blocks(blocks, size).collect():
        assert np.isnan(out[r.py, r.px, r.band])
        out[r.py, r.px, r.band] = r.v
    return out


def warp_by_hand(src, h, w_out, h_out):
    inv = np.linalg.inv(h)
    out = np.zeros((h_out, w_out, src.shape[2]))
    for y in range(h_out):
        for x in range(w_out):
            q = inv @ [x, y, 1.0]
            sx, sy = q[:2] / q[2]
            x0, y0 = int(np.floor(sx)), int(np.floor(sy))
            for dy in (0, 1):
                for dx in (0, 1):
                    if 0 <= x0 + dx < src.shape[1] and 0 <= y0 + dy < src.shape[0]:
                        weight = (sx - x0 if dx else 1 - sx + x0) * (sy - y0 if dy else 1 - sy + y0)
                        out[y, x] += weight * src[y0 + dy, x0 + dx]
    return out


@pytest.mark.parametrize("h", [
    np.eye(3),
    np.array([[1, 0, 5], [0, 1, -3], [0, 0, 1.0]]),
    np.array([[0.5, 0, 0], [0, 0.25, 0], [0, 0, 1.0]]),
    np.array([[1.2, 0.3, -4], [-0.2, 0.9, 6], [1e-3, 2e-3, 1.0]]),
    np.array([[1.0, 0, 0], [0, 1, 0], [0.05, 0, -0.6]]),
    np.array([[1.0, 0, 500], [0, 1, 0], [0, 0, 1.0]]),
])
def test_warp_matches_a_plain_loop(spark, h):
    rng = np.random.default_rng(4)
    src = rng.integers(0, 256, (21, 30, 2)).astype(float)
    frames = spark.createDataFrame(
        [(0, 30, 21, 26, 19, 2, [float(v) for v in h.ravel()])],
        "scene_id int, tgt_w bigint, tgt_h bigint, work_w bigint, work_h bigint, n_bands int, homography array<double>")
    out = read(R.warp(raster(spark, src, 8), frames, 8, rounded=False), 26, 19, 2, 8)
    assert np.allclose(out, warp_by_hand(src, h, 26, 19), atol=1e-8)


def test_crop_matches_slices(spark):
    rng = np.random.default_rng(5)
    src = rng.integers(0, 256, (20, 30, 3)).astype(float)
    frames = spark.createDataFrame([(0, 30, 20)], "scene_id int, work_w bigint, work_h bigint")
    tiles = explode_tiles(frames, tile_px=11)
    planned = {t.task_idx: t for t in tiles.collect()}
    got = {i: np.full((t.sh, t.sw, 3), np.nan) for i, t in planned.items()}
    for p in R.crop(raster(spark, src, 8), tiles, 8).collect():
        area = got[p.task_idx][p.oy:p.oy + p.ph, p.ox:p.ox + p.pw, p.band]
        assert np.isnan(area).all()
        area[:] = np.array(p.v).reshape(p.ph, p.pw)
    for i, t in planned.items():
        assert (got[i] == src[t.y0:t.y0 + t.sh, t.x0:t.x0 + t.sw]).all()


def test_rescale_edges(spark):
    nan = float("nan")
    rows = [(0, "later", 0, i, 0, v) for i, v in enumerate([-2.0, 0.0, 2.0, nan])]
    rows += [(1, "later", 0, i, 0, v) for i, v in enumerate([7.0, 7.0, 7.0, 7.0])]
    rows += [(2, "later", 0, i, 0, v) for i, v in enumerate([nan, nan, nan, nan])]
    rows += [(0, "later", 3, 0, 0, 1000.0)]
    blocks = R.to_blocks(spark.createDataFrame(rows, PIX)).withColumn("dtype", F.lit("f64"))
    got = {r.scene_id: r.v for r in R.rescale_u8(blocks).collect()}
    assert got == {0: [0, 128, 255, 0], 1: [0, 0, 0, 0], 2: [0, 0, 0, 0]}


def test_grey_of_one_and_three_bands(spark):
    rows = [(0, "later", b, 0, 0, v) for b, v in enumerate([10.0, 20.0, 30.0])] + [(1, "later", 0, 0, 0, 9.0)]
    got = {r.scene_id: r.v[0] for r in R.grey_blocks(R.to_blocks(spark.createDataFrame(rows, PIX))).collect()}
    assert got[0] == pytest.approx(0.299 * 10 + 0.587 * 20 + 0.114 * 30) and got[1] == 9.0


def test_blocks_keep_places_with_missing_and_double_samples(spark):
    pixels = [(0, "later", 0, x, y, float(10 * y + x)) for y in range(3) for x in range(3) if (x, y) != (1, 1)]
    pixels.append((0, "later", 0, 2, 2, 5.0))
    blocks = R.to_blocks(spark.createDataFrame(pixels, "scene_id int, epoch string, band int, px int, py int, v double"), 4)
    row = blocks.first()
    assert (row.bw, row.bh) == (3, 3)
    assert [v for i, v in enumerate(row.v) if i != 4] == [0, 1, 2, 10, 12, 20, 21, 22] and np.isnan(row.v[4])


def test_rasters_without_a_type_are_stretched(spark):
    pixels = spark.createDataFrame(
        [(0, "later", 0, x, 0, float(x), None) for x in range(3)],
        "scene_id int, epoch string, band int, px int, py int, v double, dtype string")
    assert [list(r.v) for r in R.rescale_u8(R.to_blocks(pixels)).collect()] == [[0.0, 128.0, 255.0]]


def mean_reduced(src, out_w, out_h):
    """Area means by cumulative sums, one side at a time."""
    def side(a, out):
        n = a.shape[0]
        sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        at = np.arange(out + 1) * n / out
        low = np.minimum(np.floor(at).astype(int), n)
        part = sums[low] + (at - low).reshape(-1, *[1] * (a.ndim - 1)) * (sums[np.minimum(low + 1, n)] - sums[low])
        return np.diff(part, axis=0) * out / n

    return side(side(src, out_h).swapaxes(0, 1), out_w).swapaxes(0, 1)


@pytest.mark.parametrize("size, tile_px, overview_px", [(8, 7, 17), (4, 1, 1), (8, 500, 30), (64, 9, 13)])
def test_scaled_crops_are_area_means(spark, size, tile_px, overview_px):
    rng = np.random.default_rng(6)
    src = rng.normal(0, 50, (23, 31, 2))
    frames = spark.createDataFrame([(0, 31, 23)], "scene_id int, work_w bigint, work_h bigint")
    tiles = explode_tiles(frames, tile_px=11, max_tile_px=tile_px, overview_px=overview_px)
    planned = {t.task_idx: t for t in tiles.collect()}
    got = {i: np.full((t.out_h, t.out_w, 2), np.nan) for i, t in planned.items()}
    for p in R.crop_scaled(raster(spark, src, size), tiles, size, rounded=False).collect():
        area = got[p.task_idx][p.by * size:p.by * size + p.bh, p.bx * size:p.bx * size + p.bw, p.band]
        assert np.isnan(area).all()
        area[:] = np.array(p.v).reshape(p.bh, p.bw)
    for i, t in planned.items():
        cut = src[t.y0:t.y0 + t.sh, t.x0:t.x0 + t.sw]
        assert np.allclose(got[i], mean_reduced(cut, t.out_w, t.out_h))


def test_missing_samples_count_as_black_in_scaled_crops(spark):
    src = np.array([[[1.0], [np.nan]], [[3.0], [4.0]]])
    tiles = spark.createDataFrame([(0, 0, 0, 0, 2, 2, 1, 1)], "scene_id int, task_idx int, x0 long, y0 long, sw long, sh long, out_w long, out_h long")
    assert [list(r.v) for r in R.crop_scaled(raster(spark, src, 8), tiles, 8, rounded=False).collect()] == [[2.0]]


def test_pairs_at_the_horizon_grow_with_pixels(spark):
    """Output blocks that the horizon crosses look up only the source blocks that their pixels sample."""
    h = np.array([[1.0, 0, 0], [0, 1, 0], [0.0625, 0, -0.625]])
    pairs = {}
    for scale in (1, 4):
        side, matrix = 64 * scale, h.copy()
        matrix[2, 0] /= scale
        m = np.linalg.det(matrix) * np.linalg.inv(matrix)
        table = spark.createDataFrame(
            [(bx, by, 8, 8, side, side, [float(v) for v in m.ravel()]) for bx in range(side // 8) for by in range(side // 8)],
            "bx bigint, by bigint, bw int, bh int, tgt_w bigint, tgt_h bigint, back array<double>")
        pairs[scale] = table.mapInArrow(
            R._reach(8), "bx bigint, by bigint, bw int, bh int, tgt_w bigint, tgt_h bigint, back array<double>, sbx bigint, sby bigint").count()
        assert pairs[scale] > table.count()
    assert pairs[4] <= 20 * pairs[1]


def test_shares_of_scaled_crops_are_added_in_sorted_order_without_lists(spark):
    """Blocks whose shares are cut by Arrow batches and repeated tiles, whose shares add up, included."""
    src = np.arange(24 * 20 * 2, dtype=float).reshape(20, 24, 2) * 7 % 251
    tiles = spark.createDataFrame(
        [(0, 0, 0, 0, 24, 20, 5, 3), (0, 1, 3, 2, 17, 15, 17, 15), (0, 2, 1, 1, 20, 18, 9, 9), (0, 2, 1, 1, 20, 18, 9, 9)],
        "scene_id int, task_idx int, x0 long, y0 long, sw long, sh long, out_w long, out_h long")
    made = R.crop_scaled(raster(spark, src, 4), tiles, 4, rounded=False)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(y" not in plan and plan.count("REPARTITION_BY_COL") == 1
    wanted = {0: mean_reduced(src, 5, 3), 1: src[2:17, 3:20], 2: 2 * mean_reduced(src[1:19, 1:21], 9, 9)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = made.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 2 * (2 * 1 + 5 * 4 + 3 * 3)
    for p in rows:
        there = wanted[p.task_idx][p.by * 4:p.by * 4 + p.bh, p.bx * 4:p.bx * 4 + p.bw, p.band]
        assert np.allclose(np.array(p.v).reshape(p.bh, p.bw), there)
