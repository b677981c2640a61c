"""Rasters as tables of pixel blocks.

A block row holds one band of up to ``size`` x ``size`` samples: (scene_id, epoch, band, bx, by, bw, bh,
v), with ``v`` row-major and bw, bh smaller at the right and bottom border. A raster of any extent is
many rows, keyed by place, so no scene is bound to one task.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import KEPT_BANDS
from ..functions.pixels import stretch_u8, to_grey, u16_to_u8
from .detector import python_values
from .skew import shuffled

BLOCK = 64
# Places side by side in a block whose samples are put together before any list is made.
RUN = 16
# Source blocks in the box around an output block's corners beyond which its pixels are looked up.
WIDE_REACH = 36
# Source samples of pieces cut alike that are reduced at once.
REDUCED_TOGETHER = 1 << 17
# Output pixels whose taps are taken or whose shares are added at once; few enough to stay in a core's cache.
TAPPED_TOGETHER = 1 << 16
ADDED_TOGETHER = 1 << 17
# Shares of samples that leave a task in one batch.
PACKED_TOGETHER = 1 << 24
PLACE = ["scene_id", "epoch", "band", "bx", "by"]
DIRECT_DTYPES = ("u8", "u16")


def to_blocks(pixels: DataFrame, size: int = BLOCK) -> DataFrame:
    """Gather rasters given as rows (scene_id, epoch, band, px, py, v) into blocks.

    Samples stand where their px and py say. Places without a sample hold NaN; of several samples of one place the
    largest counts. A block ends at its outermost sample.
    """
    # One number gives the row-major place inside the block. Runs of places are put together first, by numbers alone: of all
    # rows, only runs are gathered in lists and sorted.
    place = F.pmod("py", F.lit(size)) * size + F.pmod("px", F.lit(size))
    extra = [c for c in pixels.columns if c not in ("scene_id", "epoch", "band", "px", "py", "v")]
    within = F.pmod("_at", F.lit(RUN))
    runs = (
        pixels.select(
            "scene_id", "epoch", "band", F.floor(F.col("px") / size).alias("bx"), F.floor(F.col("py") / size).alias("by"),
            (F.pmod("px", F.lit(size)) + 1).cast("int").alias("_right"), (F.pmod("py", F.lit(size)) + 1).cast("int").alias("_low"),
            place.cast("int").alias("_at"), F.col("v").cast("double").alias("v"), *extra,
        )
        .groupBy(*PLACE, F.floor(F.col("_at") / RUN).cast("int").alias("_run"))
        .agg(
            F.max("_right").alias("_right"), F.max("_low").alias("_low"), *[F.min(c).alias(c) for c in extra],
            F.count(F.lit(1)).alias("_n"), F.bit_or(F.expr(f"shiftleft(1, pmod(_at, {RUN}))")).alias("_there"),
            *[F.max(F.when(within == i, F.col("v"))).alias(f"_v{i}") for i in range(RUN)],
        )
    )
    run = F.struct("_run", "_there", F.array(*[f"_v{i}" for i in range(RUN)]).alias("_v"))
    gathered = runs.groupBy(*PLACE).agg(
        F.max("_right").alias("bw"), F.max("_low").alias("bh"), *[F.min(c).alias(c) for c in extra],
        F.sum("_n").alias("_n"), F.min("_there").alias("_all"), F.sort_array(F.collect_list(run)).alias("_r"),
    )
    # A full block has its samples in order already; only others are placed one by one.
    full = (F.col("_n") == F.col("bw") * F.col("bh")) & (F.size("_r") * RUN == F.col("_n")) & (F.col("_all") == (1 << RUN) - 1)
    return gathered.withColumn("v", F.when(full, F.flatten("_r._v")).otherwise(_placed(size))).drop("_r", "_n", "_all")


def _placed(size: int) -> Column:
    """The samples of the sorted runs ``_r`` of a block that are not all there or do not begin and end with a run."""
    samples = F.flatten(F.transform("_r", lambda r: F.filter(
        F.transform(r["_v"], lambda v, i: F.struct(
            (r["_run"] * RUN + i).alias("at"), v.alias("v"), F.get(F.lit([1 << k for k in range(RUN)]), i).bitwiseAND(r["_there"]).alias("there"))),
        lambda s: s["there"] != 0)))
    by_place = F.map_from_entries(F.transform(samples, lambda s: F.struct(s["at"], s["v"])))
    filled = F.transform(
        F.sequence(F.lit(0), F.col("bw") * F.col("bh") - 1),
        lambda i: F.coalesce(
            F.try_element_at(by_place, (F.floor(i / F.col("bw")) * size + F.pmod(i, F.col("bw"))).cast("int")),
            F.lit(float("nan")),
        ),
    )
    # Without missing or double samples the rows' order is that of the block.
    each_once = (F.col("_n") == F.col("bw") * F.col("bh")) & (F.size(samples) == F.col("_n"))
    return F.when(each_once, F.transform(samples, lambda s: s["v"])).otherwise(filled)


def image_blocks(decoded: DataFrame, size: int = BLOCK) -> DataFrame:
    """Cut decoded images (scene_id, epoch, width, height, n_channels, data) into blocks, RGB order.

    The bytes of each block are cut out on the JVM side, so no whole image enters a Python batch.
    """
    key = decoded.schema["scene_id"].dataType.simpleString()
    valid = decoded.where("reject_reason is null") if "reject_reason" in decoded.columns else decoded

    def extent(cell: str, full: str) -> Column:
        return F.least(F.lit(size), F.col(full) - F.col(cell) * size).cast("int")

    across = F.ceil(F.col("width") / size)
    cells = F.sequence(F.lit(0).cast("bigint"), across * F.ceil(F.col("height") / size) - 1)
    placed = (
        valid.select("scene_id", "epoch", "width", "height", "n_channels", "data", F.explode(cells).alias("_i"))
        .withColumn("bx", F.pmod("_i", across)).withColumn("by", F.floor(F.col("_i") / across))
        .withColumn("bw", extent("bx", "width")).withColumn("bh", extent("by", "height"))
    )
    line = F.transform(
        F.sequence(F.lit(0), F.col("bh") - 1),
        lambda y: F.substring(
            "data",
            (((F.col("by") * size + y) * F.col("width") + F.col("bx") * size) * F.col("n_channels") + 1).cast("int"),
            F.col("bw") * F.col("n_channels"),
        ),
    )
    pieces = placed.select("scene_id", "epoch", "bx", "by", "bw", "bh", "n_channels", line.alias("lines"))

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                samples = np.frombuffer(b"".join(r.lines), np.uint8).reshape(-1, r.n_channels).astype(float)
                order = [2, 1, 0, *range(3, r.n_channels)] if r.n_channels >= 3 else range(r.n_channels)
                rows += [
                    (r.scene_id, r.epoch, band, r.bx, r.by, r.bw, r.bh, samples[:, at].copy())
                    for band, at in enumerate(order)
                ]
            yield pd.DataFrame(rows, columns=[*PLACE, "bw", "bh", "v"])

    return pieces.mapInPandas(
        bands, f"scene_id {key}, epoch string, band int, bx bigint, by bigint, bw int, bh int, v array<double>"
    ).withColumn("dtype", F.lit("u8"))


def explode_blocks(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """Back to one row per sample."""
    keep = [c for c in blocks.columns if c not in ("bx", "by", "bw", "bh", "v")]
    at = blocks.select(*keep, "bx", "by", "bw", F.posexplode("v").alias("_i", "v"))
    return at.select(
        *keep,
        (F.col("bx") * size + F.pmod("_i", "bw")).alias("px"),
        (F.col("by") * size + F.floor(F.col("_i") / F.col("bw"))).alias("py"), "v",
    )


def keep_bands(blocks: DataFrame, count: int = KEPT_BANDS) -> DataFrame:
    """Only the first bands; on Parquet the predicate is pushed to the scan."""
    return blocks.where(F.col("band") < count)


def raster_range(blocks: DataFrame) -> DataFrame:
    """Joint minimum and maximum of an image over its bands, NaN ignored.

    Each block is reduced to two numbers before anything is shuffled.
    """
    numbers = F.filter("v", lambda s: ~F.isnan(s))
    return (
        blocks.select("scene_id", "epoch", F.array_min(numbers).alias("lo"), F.array_max(numbers).alias("hi"))
        .groupBy("scene_id", "epoch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )


def rescale_u8(blocks: DataFrame, bands: int = KEPT_BANDS) -> DataFrame:
    """Bring samples to 0..255 by the ``dtype`` of the block: 'u8', 'u16' or anything else (stretched).

    Only stretched images need their range; eight- and sixteen-bit ones bypass that aggregation.
    """
    kept = keep_bands(blocks, bands)
    known = F.coalesce(F.col("dtype").isin(*DIRECT_DTYPES), F.lit(False))
    direct, other = kept.where(known), kept.where(~known)
    as_u8 = F.when(
        F.col("dtype") == "u16", F.transform("v", lambda s: u16_to_u8(s).cast("double"))
    ).otherwise(F.col("v"))
    stretched = other.join(raster_range(other), ["scene_id", "epoch"]).withColumn(
        "v", F.transform("v", lambda s: stretch_u8(s, F.col("lo"), F.col("hi")).cast("double"))
    )
    return direct.withColumn("v", as_u8).unionByName(stretched.select(*kept.columns))


def grey_blocks(blocks: DataFrame) -> DataFrame:
    """One grey block per place, from three bands or from a single one."""
    at = ["scene_id", "epoch", "bx", "by", "bw", "bh"]

    def band(i: int) -> Column:
        return F.first(F.when(F.col("band") == i, F.col("v")), ignorenulls=True).alias(f"_b{i}")

    three = keep_bands(blocks).groupBy(*at).agg(band(0), band(1), band(2))
    grey = F.when(F.col("_b2").isNull(), F.col("_b0")).otherwise(
        F.transform("_b0", lambda r, i: to_grey(r, F.get("_b1", i), F.get("_b2", i)))
    )
    return three.select(*at, grey.alias("v"))


def crop(blocks: DataFrame, tiles: DataFrame, size: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of the blocks that lie in each tile, with their offset (ox, oy) inside the tile and the ``carry`` columns of the tile.

    A tile is spread over the blocks it touches, which turns the range condition into an equi-join
    on (scene_id, bx, by). Every tile-block pair meets once, so no duplicates arise.
    """
    def touched(start: str, extent: str) -> Column:
        last = F.floor((F.col(start) + F.col(extent) - 1) / size)
        return F.explode(F.sequence(F.floor(F.col(start) / size), last))

    spread = (
        tiles.select("scene_id", "task_idx", *dict.fromkeys(["x0", "y0", "sw", "sh", *carry]), touched("x0", "sw").alias("bx"))
        .withColumn("by", touched("y0", "sh"))
    )

    def overlap(cell: str, count: str, start: str, extent: str) -> tuple[Column, Column]:
        origin = F.col(cell) * size
        low = F.greatest(origin, F.col(start)) - origin
        high = F.least(origin + F.col(count), F.col(start) + F.col(extent)) - origin
        return low.cast("int"), high.cast("int")

    (left, right), (top, bottom) = overlap("bx", "bw", "x0", "sw"), overlap("by", "bh", "y0", "sh")
    met = (
        blocks.join(shuffled(spread), ["scene_id", "bx", "by"])
        .withColumn("_l", left).withColumn("_r", right).withColumn("_t", top).withColumn("_b", bottom)
        .where((F.col("_r") > F.col("_l")) & (F.col("_b") > F.col("_t")))
    )
    lines = F.transform(
        F.sequence(F.col("_t"), F.col("_b") - 1),
        lambda y: F.slice("v", y * F.col("bw") + F.col("_l") + 1, F.col("_r") - F.col("_l")),
    )
    # Inner blocks of a tile are taken as they are, and full lines in one cut.
    wide = (F.col("_l") == 0) & (F.col("_r") == F.col("bw"))
    cut = (
        F.when(wide & (F.col("_t") == 0) & (F.col("_b") == F.col("bh")), F.col("v"))
        .when(wide, F.slice("v", F.col("_t") * F.col("bw") + 1, (F.col("_b") - F.col("_t")) * F.col("bw")))
        .otherwise(F.flatten(lines))
    )
    return met.select(
        "scene_id", "epoch", "task_idx", "band", "bx", "by",
        (F.col("bx") * size + F.col("_l") - F.col("x0")).alias("ox"),
        (F.col("by") * size + F.col("_t") - F.col("y0")).alias("oy"),
        (F.col("_r") - F.col("_l")).alias("pw"), (F.col("_b") - F.col("_t")).alias("ph"), *carry,
        cut.alias("v"),
    )


def _cover(offset: int, count: int, extent: int, out: int) -> tuple[int, np.ndarray]:
    """First output cell that samples offset..offset+count of a side touch, and the overlap of each cell with each sample.

    ``out`` cells share ``extent`` samples. In units of 1/out of a sample every cell is ``extent`` long and overlaps are whole numbers.
    """
    first, last = offset * out // extent, ((offset + count) * out - 1) // extent
    cells, samples = np.arange(first, last + 1)[:, None], np.arange(offset, offset + count)[None, :]
    overlap = np.minimum((cells + 1) * extent, (samples + 1) * out) - np.maximum(cells * extent, samples * out)
    return first, np.maximum(overlap, 0).astype(np.float64)


def _packed(parts: list[np.ndarray], counts: np.ndarray, kind: type) -> pa.Array:
    """Numbers as the bytes of a binary column, ``counts`` of them a row: Spark copies these at once, lists number by number."""
    data = np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)
    ends = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each row of a ``_packed`` column has, and all of them."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, kind)
    return np.diff(ends) // data.itemsize, data


def _whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], most: int,
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows sorted by ``keys``, cut after groups into parts of about ``most`` rows: rows, the group of each row, the first row of each group."""
    held = None
    for batch in chain(batches, [None]):
        rows, held = held, None
        if batch is not None and len(batch):
            rows = batch if rows is None else pa.concat_batches([rows, batch])
        if rows is None:
            continue
        # The rows of a group follow each other; those of the last group may go on in the next batch.
        codes = [pa.compute.dictionary_encode(rows.column(n), null_encoding="encode").indices.to_numpy() for n in keys]
        new = np.any([np.diff(c, prepend=-1) != 0 for c in codes], axis=0)
        first = np.flatnonzero(new)
        if batch is not None:
            held, rows, new, first = rows.slice(first[-1]), rows.slice(0, first[-1]), new[:first[-1]], first[:-1]
        group, lo = np.cumsum(new) - 1, 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + most)))
            a, b = first[lo], first[hi] if hi < len(first) else len(rows)
            yield rows.slice(a, b - a), group[a:b] - lo, first[lo:hi] - a
            lo = hi


def crop_scaled(
    blocks: DataFrame, tiles: DataFrame, size: int = BLOCK, rounded: bool = True, sample: str = "double",
) -> DataFrame:
    """The tiles (x0, y0, sw, sh) reduced to out_w x out_h samples, as blocks of the reduced tile.

    Rows (scene_id, epoch, task_idx, band, bx, by, bw, bh, v). An output sample is the mean of the source samples under it,
    weighted by overlap. Both directions are reduced where the samples are: a piece of a source block becomes its share of at most
    as many output samples as it has itself, and only shares are shuffled and added up per output block. Weights are whole
    numbers, so sums of whole samples are exact in any order. ``out_w`` and ``out_h`` may not exceed sw and sh. Samples that
    are missing (NaN) count as black. ``sample`` is the type of the samples given back, "double" or "float".
    """
    key = blocks.schema["scene_id"].dataType.simpleString()
    pieces = crop(blocks, tiles, size, ("sw", "sh", "out_w", "out_h"))
    kept = ["scene_id", "epoch", "task_idx", "band"]
    sides = ["ox", "oy", "pw", "ph", "sw", "sh", "out_w", "out_h"]
    share_type = "bx bigint, by bigint, bw int, bh int, area bigint, x int, y int, w int, h int, v binary"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("v").offsets.to_numpy()
            values = np.nan_to_num(batch.column("v").values.to_numpy(zero_copy_only=False), nan=0.0)
            # Bands of a piece, and other pieces cut alike, share their weights and are reduced together.
            alike: dict[tuple, list[int]] = {}
            for i, at in enumerate(zip(*(batch.column(n).to_pylist() for n in sides))):
                alike.setdefault(at, []).append(i)
            rows, places, parts, held = [], [], [], 0

            def made() -> pa.RecordBatch:
                counts = [len(some) for some in rows]
                take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                types = (np.int64, np.int64, np.int32, np.int32, np.int64, *[np.int32] * 4)
                columns = [np.repeat(np.array([p[c] for p in places], t), counts) for c, t in enumerate(types)]
                return pa.RecordBatch.from_arrays(
                    [*(batch.column(n).take(take) for n in kept), *map(pa.array, columns),
                     _packed(parts, columns[-1].astype(np.int64) * columns[-2], np.float64)],
                    names=[*kept, "bx", "by", "bw", "bh", "area", "x", "y", "w", "h", "v"],
                )

            for (ox, oy, pw, ph, sw, sh, out_w, out_h), members in alike.items():
                x, across = _cover(ox, pw, sw, out_w)
                y, down = _cover(oy, ph, sh, out_h)
                h, w = len(down), len(across)
                many = max(1, REDUCED_TOGETHER // (ph * pw))
                for lo in range(0, len(members), many):
                    some = np.array(members[lo:lo + many])
                    part = values[starts[some][:, None] + np.arange(ph * pw)].reshape(-1, ph, pw)
                    # A side that keeps its size weighs each sample alike.
                    part = part * float(sh) if sh == out_h else down @ part
                    part = part * float(sw) if sw == out_w else part @ across.T
                    for by in range(y // size, (y + h - 1) // size + 1):
                        top, bottom = max(y, by * size), min(y + h, by * size + size)
                        for bx in range(x // size, (x + w - 1) // size + 1):
                            left, right = max(x, bx * size), min(x + w, bx * size + size)
                            rows.append(some)
                            places.append((
                                bx, by, min(size, out_w - bx * size), min(size, out_h - by * size), sw * sh,
                                left - bx * size, top - by * size, right - left, bottom - top,
                            ))
                            parts.append(part[:, top - y:bottom - y, left - x:right - x].ravel())
                            held += len(parts[-1])
                    if held > PACKED_TOGETHER:
                        yield made()
                        rows, places, parts, held = [], [], [], 0
            yield made()

    shares = pieces.select(*kept, *sides, "v").mapInArrow(
        reduce, f"scene_id {key}, epoch string, task_idx int, band int, {share_type}"
    )
    # Shares meet only here, so they are shuffled and sorted as they are; lists gathered before the shuffle would be sorted twice.
    place = [*kept, "bx", "by", "bw", "bh", "area"]
    met = shares.repartition(*place).sortWithinPartitions(*place, "y", "x", "h", "w", "v")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block, first in _whole_groups(batches, place, max(1, ADDED_TOGETHER // size ** 2)):
            whole = rows.take(pa.array(first)).select([*kept, "bx", "by", "bw", "bh", "area"])
            bw, bh, area = (whole.column(n).to_numpy() for n in ("bw", "bh", "area"))
            ends = np.concatenate([[0], np.cumsum(bw.astype(np.int64) * bh)])
            # Every sample of every share finds its place in its block; shares of a block are added in their order.
            y, x, h, w = (rows.column(n).to_numpy() for n in "yxhw")
            sizes, width = h.astype(np.int64) * w, bw[block].astype(np.int64)
            start = np.cumsum(sizes) - sizes
            at = np.arange(int(sizes.sum())) + np.repeat(ends[block] + y * width + x - start, sizes)
            # Lines of a share narrower than its block stand apart.
            narrow = w < width
            if narrow.any():
                n = sizes[narrow]
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at[np.repeat(narrow, sizes)] += inside // np.repeat(w[narrow], n) * np.repeat((width - w)[narrow], n)
            v = np.bincount(at, _unpacked(rows.column("v"), np.float64)[1], int(ends[-1])) / np.repeat(area, np.diff(ends))
            v = np.floor(v + 0.5) if rounded else v
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(v.astype(np.float32) if sample == "float" else v))
            yield pa.RecordBatch.from_arrays([*whole.columns[:-1], lists], names=[*whole.schema.names[:-1], "v"])

    return met.mapInArrow(
        add_up, f"scene_id {key}, epoch string, task_idx int, band int, bx bigint, by bigint, bw int, bh int, v array<{sample}>"
    )


# --- warping ------------------------------------------------------------------------


def _back(homography: Column) -> list[Column]:
    """Frame-to-source mapping up to scale: the adjugate of the homography, which needs no division."""
    def h(i: int) -> Column:
        return F.get(homography, F.lit(i))

    def minor(a: int, b: int, c: int, d: int) -> Column:
        return h(a) * h(d) - h(b) * h(c)

    return [
        minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5),
        minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3),
        minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4),
    ]


def _reached(size: int) -> tuple[Column, Column]:
    """Ranges of source block columns and rows that an output block can sample under a map without a horizon.

    The block maps into the box around its mapped corners.
    """
    m = [F.get("back", F.lit(i)) for i in range(9)]
    xs = [(F.col("bx") * size).cast("double"), (F.col("bx") * size + F.col("bw") - 1).cast("double")]
    ys = [(F.col("by") * size).cast("double"), (F.col("by") * size + F.col("bh") - 1).cast("double")]

    def blocks(row: int, extent: str) -> Column:
        at = [(m[row] * x + m[row + 1] * y + m[row + 2]) / F.nullif(m[8], F.lit(0.0)) for x in xs for y in ys]
        last = F.col(extent) - 1
        # Rounding keeps the order of positions along a line, so no pixel lies beyond the corners. A whole position has one tap.
        low = F.greatest(F.lit(0.0), F.floor(F.least(*at)))
        high = F.least(last.cast("double"), F.ceil(F.greatest(*at)))
        first, final = F.floor(low / size), F.floor(high / size)
        return F.when(low <= high, F.sequence(first, F.greatest(first, final))).otherwise(
            F.array(F.lit(-1).cast("bigint")))

    return blocks(0, "tgt_w"), blocks(3, "tgt_h")


def _reach(size: int):
    """mapInArrow over output blocks: one row (..., sbx, sby) per source block that their pixels can sample, at least one.

    A block on one side of the horizon maps into the box around its corners. Where the horizon crosses the block, or that box is wide,
    the taps of its pixels are looked up: a pixel has four, so the block reaches no more source blocks than that, wherever
    its pixels fall. A block without any gives the source block -1, -1.
    """
    nothing = np.array([[-1, -1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bx, by, bw, bh, src_w, src_h = (batch.column(n).to_numpy() for n in ("bx", "by", "bw", "bh", "tgt_w", "tgt_h"))
            back = batch.column("back").flatten().to_numpy(zero_copy_only=False).reshape(-1, 9)
            xs = np.stack([bx * size, bx * size, bx * size + bw - 1, bx * size + bw - 1])
            ys = np.stack([by * size, by * size + bh - 1] * 2)
            at_x, at_y, depth = (back[:, i] * xs + back[:, i + 1] * ys + back[:, i + 2] for i in (0, 3, 6))
            one_side = (depth > 0).all(axis=0) | (depth < 0).all(axis=0)
            # One pixel of slack covers rounding at the corners; without perspective rounding keeps the order along a line.
            slack = np.where((back[:, 6] == 0) & (back[:, 7] == 0), 0, 1)
            spans = []
            with np.errstate(all="ignore"):
                for at, extent in ((at_x / depth, src_w), (at_y / depth, src_h)):
                    low = np.clip(np.floor(at.min(axis=0)) - slack, 0, extent)
                    high = np.clip(np.ceil(at.max(axis=0)) + slack, -1, extent - 1)
                    spans += [np.where(one_side, low, 0).astype(np.int64), np.where(one_side, high, -1).astype(np.int64)]
            left, right, top, bottom = spans
            counts = (right // size - left // size + 1) * (bottom // size - top // size + 1)
            row, found = [], []
            for i in range(len(batch)):
                if one_side[i] and (left[i] > right[i] or top[i] > bottom[i]):
                    pairs = nothing
                elif one_side[i] and counts[i] <= WIDE_REACH:
                    columns, lines = np.arange(left[i] // size, right[i] // size + 1), np.arange(top[i] // size, bottom[i] // size + 1)
                    pairs = np.stack([np.repeat(columns, len(lines)), np.tile(lines, len(columns))], axis=1)
                else:
                    cols, rows, weights = _taps(back[i], bx[i] * size, by[i] * size, bw[i], bh[i], src_w[i], src_h[i])
                    used = weights != 0
                    pairs = np.unique(np.stack([cols[used] // size, rows[used] // size], axis=1), axis=0) if used.any() else nothing
                row.append(np.full(len(pairs), i))
                found.append(pairs)
            take = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(take) for c in batch.columns), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                names=[*batch.schema.names, "sbx", "sby"],
            )

    return run


def _taps(back: np.ndarray, x0: int, y0: int, w: int, h: int, src_w: int, src_h: int) -> tuple:
    """Source columns, rows and weights of the four bilinear taps of each pixel of a block."""
    xs, ys = np.meshgrid(np.arange(x0, x0 + w, dtype=float), np.arange(y0, y0 + h, dtype=float))
    sx, sy, depth = (back[i] * xs + back[i + 1] * ys + back[i + 2] for i in (0, 3, 6))
    with np.errstate(all="ignore"):
        sx, sy = (sx / depth).ravel(), (sy / depth).ravel()
        near = (sx > -1) & (sy > -1) & (sx < src_w) & (sy < src_h)
    sx, sy = np.where(near, sx, -2.0), np.where(near, sy, -2.0)
    fx, fy = np.floor(sx), np.floor(sy)
    part_x, part_y = sx - fx, sy - fy
    fx, fy = fx.astype(np.int64), fy.astype(np.int64)
    cols = np.stack([fx, fx + 1, fx, fx + 1])
    rows = np.stack([fy, fy, fy + 1, fy + 1])
    weights = np.stack([
        (1 - part_x) * (1 - part_y), part_x * (1 - part_y), (1 - part_x) * part_y, part_x * part_y,
    ])
    return cols, rows, np.where((cols >= 0) & (rows >= 0) & (cols < src_w) & (rows < src_h), weights, 0.0)


def _block_taps(
    back: np.ndarray, x0: np.ndarray, y0: np.ndarray, w: int, h: int, src_w: np.ndarray, src_h: np.ndarray,
    left: np.ndarray, top: np.ndarray, size: int,
) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The taps of many output blocks of one size in one source block each, whose corner is at ``left`` and ``top``.

    Block and pixel of every output pixel with a tap there, and column, line and weight of its four taps in ``_taps``' order;
    those outside the source block weigh nothing.
    """
    xs, ys = (x0[:, None] + np.arange(w, dtype=float))[:, None, :], (y0[:, None] + np.arange(h, dtype=float))[:, :, None]
    m = back.T[:, :, None, None]
    wide, high = np.minimum(src_w - left, size), np.minimum(src_h - top, size)
    with np.errstate(all="ignore"):
        sx, sy, depth = (m[i] * xs + m[i + 1] * ys + m[i + 2] for i in (0, 3, 6))
        sx, sy = sx / depth, sy / depth
        x_from, y_from, x_to, y_to = (v[:, None, None] for v in (left - 1, top - 1, left + wide, top + high))
        at = np.flatnonzero((sx >= x_from) & (sx < x_to) & (sy >= y_from) & (sy < y_to))
    block, pixel = np.divmod(at, w * h)
    sx, sy = sx.ravel()[at], sy.ravel()[at]
    fx, fy = np.floor(sx), np.floor(sy)
    part_x, part_y = sx - fx, sy - fy
    col, line = fx.astype(np.int64) - left[block], fy.astype(np.int64) - top[block]
    wide, high = wide[block], high[block]
    in_x = [np.where((col + i >= 0) & (col + i < wide), part, 0.0) for i, part in ((0, 1 - part_x), (1, part_x))]
    in_y = [np.where((line + i >= 0) & (line + i < high), part, 0.0) for i, part in ((0, 1 - part_y), (1, part_y))]
    weights = [in_x[0] * in_y[0], in_x[1] * in_y[0], in_x[0] * in_y[1], in_x[1] * in_y[1]]
    used = (weights[0] != 0) | (weights[1] != 0) | (weights[2] != 0) | (weights[3] != 0)
    if not used.all():
        block, pixel, col, line, weights = block[used], pixel[used], col[used], line[used], [v[used] for v in weights]
    return block, pixel, [(col + i, line + j, v) for (i, j), v in zip(((0, 0), (1, 0), (0, 1), (1, 1)), weights)]


def resize(blocks: DataFrame, frames: DataFrame, size: int = BLOCK, epoch: str = "earlier") -> DataFrame:
    """Bring one epoch to the working frame by scaling alone; ``frames`` as for ``warp`` without ``homography``."""
    zero, one = F.lit(0.0), F.lit(1.0)
    across, down = (F.try_divide(F.col(f"work_{c}"), F.col(f"tgt_{c}")) for c in "wh")
    scaling = F.array(across, zero, zero, zero, down, zero, zero, zero, one)
    return warp(blocks, frames.withColumn("homography", scaling), size, epoch, affine=True)


def tile_pieces(crops: DataFrame) -> DataFrame:
    """One row per task with ``pieces``, those of ``crop`` or the blocks of ``crop_scaled``, samples as floats.

    A row holds one tile pair, whose size is bounded: after ``crop_scaled`` by out_w x out_h.
    """
    ordered = [c for c in ("oy", "ox", "pw", "ph", "by", "bx", "bw", "bh") if c in crops.columns]
    piece = F.struct("epoch", "band", *ordered, F.col("v").cast("array<float>").alias("v"))
    return crops.groupBy("scene_id", "task_idx").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))


def png(samples: np.ndarray) -> bytes:
    """An eight-bit PNG file of samples (rows, columns, bands) with one or three bands."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, bands = samples.shape
    lines = np.zeros((h, 1 + w * bands), np.uint8)
    lines[:, 1:] = samples.reshape(h, -1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if bands == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def tile_images(tasks: DataFrame, size: int = BLOCK) -> DataFrame:
    """Add ``reference`` and ``target``, the earlier and later image of a task as PNG data URLs, in place of ``pieces``.

    ``tasks`` has out_w, out_h and the pieces of ``crop_scaled``, with samples of 0 to 255 (others are clipped). Three bands give a
    colour image, fewer a grey one of the first; places without a piece are black, and a date without any piece has no image.
    """
    kept = [c for c in tasks.columns if c != "pieces"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tasks.select(*kept).schema.fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = {"earlier": [], "later": []}
            columns = [batch.column(n).to_pylist() for n in ("out_w", "out_h")]
            # One row at a time becomes Python values: a batch may hold many tiles.
            for i, (w, h) in enumerate(zip(*columns)):
                pieces = python_values(batch.column("pieces").slice(i, 1))[0] or []
                for epoch, out in urls.items():
                    mine = [p for p in pieces if p["epoch"] == epoch]
                    bands = 3 if any(p["band"] == 2 for p in mine) else 1
                    image = np.zeros((h, w, bands), np.uint8)
                    for p in mine:
                        if p["band"] < bands:
                            y, x = p["by"] * size, p["bx"] * size
                            part = np.clip(np.nan_to_num(p["v"]), 0, 255).reshape(p["bh"], p["bw"])
                            image[y:y + p["bh"], x:x + p["bw"], p["band"]] = part
                    out.append("data:image/png;base64," + base64.b64encode(png(image)).decode() if mine else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), *(pa.array(u, pa.string()) for u in urls.values())], names=[*kept, "reference", "target"])

    return tasks.mapInArrow(encode, f"{types}, reference string, target string")


def warp(
    blocks: DataFrame, frames: DataFrame, size: int = BLOCK, epoch: str = "later", rounded: bool = True, affine: bool = False,
) -> DataFrame:
    """Warp one epoch to the working frame: bilinear, black outside the source.

    ``frames`` has scene_id, tgt_w, tgt_h (source extent), work_w, work_h, n_bands and ``homography``
    (nine numbers, source to frame). Each output block is joined to just the source blocks its pixels
    can sample, and the partial sums are added up per output block; all shuffles are keyed by place. Blocks that the horizon of a
    perspective crosses look up the taps of their own pixels. ``affine`` says that no homography has a horizon and keeps this step on the JVM.
    """
    key = blocks.schema["scene_id"].dataType.simpleString()

    def steps(extent: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(extent) - 1) / size)))

    outputs = (
        frames.withColumn("back", F.array(*_back(F.col("homography"))))
        .select("scene_id", "tgt_w", "tgt_h", "work_w", "work_h", "n_bands", "back", steps("work_h").alias("by"))
        .withColumn("bx", steps("work_w"))
        .withColumn("bw", F.least(F.lit(size), F.col("work_w") - F.col("bx") * size).cast("int"))
        .withColumn("bh", F.least(F.lit(size), F.col("work_h") - F.col("by") * size).cast("int"))
        .drop("work_w", "work_h")
    )
    if affine:
        across, down = _reached(size)
        reached = outputs.withColumn("sbx", F.explode(across)).withColumn("sby", F.explode(down))
    else:
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outputs.schema.fields)
        reached = outputs.mapInArrow(_reach(size), f"{types}, sbx bigint, sby bigint")
    source = blocks.where(F.col("epoch") == epoch).select(
        "scene_id", F.col("band").cast("int").alias("band"), F.col("bx").alias("sbx"), F.col("by").alias("sby"),
        F.col("bw").alias("sbw"), F.col("v").alias("sv"),
    )
    # Output blocks without any source still give black blocks in every band.
    met = reached.join(shuffled(source), ["scene_id", "sbx", "sby"], "left").withColumn(
        "band", F.explode(F.when(F.col("band").isNull(), F.sequence(F.lit(0), F.col("n_bands") - 1)).otherwise(
            F.array("band")))
    ).select("scene_id", "band", "bx", "by", "bw", "bh", "tgt_w", "tgt_h", "back", "sbx", "sby", "sbw", "sv")

    kept = ["scene_id", "band", "bx", "by", "bw", "bh", "sbx", "sby"]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column("sv")
            there = np.flatnonzero(source.is_valid().to_numpy(zero_copy_only=False))
            # Output blocks whose source block is missing keep a row, without samples.
            rows, counts = [np.flatnonzero(source.is_null().to_numpy(zero_copy_only=False))], [np.zeros(len(batch) - len(there), np.int64)]
            at, shares, held = [], [], 0

            def made() -> pa.RecordBatch:
                take, each = pa.array(np.concatenate(rows)), np.concatenate(counts)
                return pa.RecordBatch.from_arrays(
                    [*[batch.column(n).take(take) for n in kept], _packed(at, each, np.int32), _packed(shares, each, np.float64)],
                    names=[*kept, "at", "share"])

            if len(there):
                starts, values = source.offsets.to_numpy().astype(np.int64), source.values.to_numpy(zero_copy_only=False)
                values = values if len(values) else np.zeros(1)
                sbw = batch.column("sbw").fill_null(0).to_numpy().astype(np.int64)
                back = batch.column("back").take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 9)
                scene = pa.compute.dictionary_encode(batch.column("scene_id"), null_encoding="encode").indices.to_numpy()[there]
                whole = [batch.column(n).to_numpy(zero_copy_only=False)[there].astype(np.int64) for n in ("bx", "by", "bw", "bh", "tgt_w", "tgt_h", "sbx", "sby")]
                # The bands of one place follow each other and share their taps.
                new = np.any([np.diff(c, prepend=c[0] - 1) != 0 for c in (scene, *whole)], axis=0)
                new[1:] |= (back[1:] != back[:-1]).any(axis=1)
                first = np.flatnonzero(new)
                bands = np.diff(first, append=len(there))
                bw, bh = whole[2][first], whole[3][first]
                for w, h in sorted(set(zip(bw.tolist(), bh.tolist()))):
                    alike = np.flatnonzero((bw == w) & (bh == h))
                    many = max(1, TAPPED_TOGETHER // (w * h))
                    for lo in range(0, len(alike), many):
                        some = alike[lo:lo + many]
                        one = first[some]
                        bx, by, _, _, src_w, src_h, sbx, sby = (c[one] for c in whole)
                        place, pixel, taps = _block_taps(back[one], bx * size, by * size, w, h, src_w, src_h, sbx * size, sby * size, size)
                        for band in range(int(bands[some].max())):
                            has = bands[some] > band
                            mine = slice(None) if has.all() else has[place]
                            owner, row = place[mine], there[np.minimum(one + band, len(there) - 1)]
                            start, stride, length = starts[row][owner], sbw[row][owner], (starts[row + 1] - starts[row])[owner]
                            total = np.zeros(len(owner))
                            for col, line, weight in taps:
                                weight = weight[mine]
                                used = weight != 0
                                index = line[mine] * stride + col[mine]
                                if (used & (index >= length)).any():
                                    raise IndexError("a source block is smaller than the extent of its image")
                                total += np.where(used, values[np.where(used, start + index, 0)], 0.0) * weight
                            rows.append(row[has])
                            counts.append(np.bincount(owner, minlength=len(some))[has])
                            at.append(pixel[mine])
                            shares.append(total)
                            held += len(total)
                            if held > PACKED_TOGETHER:
                                yield made()
                                rows, counts, at, shares, held = [], [], [], [], 0
            if rows:
                yield made()

    partial = met.mapInArrow(
        sample,
        f"scene_id {key}, band int, bx bigint, by bigint, bw int, bh int, sbx bigint, sby bigint,"
        " at binary, share binary",
    )
    out_keys = ["scene_id", "band", "bx", "by", "bw", "bh"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block, first in _whole_groups(batches, out_keys, max(1, ADDED_TOGETHER // size ** 2)):
            whole = rows.take(pa.array(first)).select(out_keys)
            ends = np.concatenate([[0], np.cumsum(whole.column("bw").to_numpy().astype(np.int64) * whole.column("bh").to_numpy())])
            counts, at = _unpacked(rows.column("at"), np.int32)
            at = np.repeat(ends[block], counts) + at
            v = np.bincount(at, _unpacked(rows.column("share"), np.float64)[1], int(ends[-1])).astype(np.float64)
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), np.floor(v + 0.5) if rounded else v)
            yield pa.RecordBatch.from_arrays([*whole.columns, lists], names=[*out_keys, "v"])

    # Shares meet only here, so they are shuffled and sorted as they are. The sort fixes the order of the sum.
    summed = partial.repartition(*out_keys).sortWithinPartitions(*out_keys, "sby", "sbx", "at", "share").mapInArrow(
        add_up, f"scene_id {key}, band int, bx bigint, by bigint, bw int, bh int, v array<double>")
    return summed.select("scene_id", F.lit(epoch).alias("epoch"), "band", "bx", "by", "bw", "bh", "v")
