"""Scene pairs, working frames and the plan of overlapping tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.numeric import shrink_to


def pair_scenes(images: DataFrame) -> DataFrame:
    """Scenes that have both an earlier and a later image.

    Rows with a ``reject_reason`` take no part. Of several images of one (scene_id, epoch) the newest by
    ``modificationTime`` counts (else the largest row); ``surplus_images`` lists such scenes. A single
    aggregation replaces the self-join: one shuffle, combined map-side.
    """
    return _by_epoch(images).where(F.col("earlier").isNotNull() & F.col("later").isNotNull())


def surplus_images(images: DataFrame) -> DataFrame:
    """Scenes and epochs with more than one usable image: (scene_id, epoch, n)."""
    return _usable(images).groupBy("scene_id", "epoch").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _usable(images: DataFrame) -> DataFrame:
    return images.where(F.col("reject_reason").isNull()) if "reject_reason" in images.columns else images


def unpaired_scenes(images: DataFrame) -> DataFrame:
    """Scenes that miss one of the two images, with the epoch they do have."""
    lonely = _by_epoch(images).where(F.col("earlier").isNull() | F.col("later").isNull())
    return lonely.select(
        "scene_id", F.when(F.col("earlier").isNotNull(), "earlier").otherwise("later").alias("epoch")
    )


def _by_epoch(images: DataFrame) -> DataFrame:
    fields = [c for c in images.columns if c not in ("scene_id", "epoch")]
    image = F.struct(*(fields or [F.lit(True).alias("present")]))
    age = [c for c in ("modificationTime",) if c in fields]
    order = F.struct(*age, *[c for c in fields if c not in age and c not in ("content", "data")])
    order = order if fields else F.struct(F.lit(True))
    return _usable(images).groupBy("scene_id").agg(
        *[F.max_by(image, F.when(F.col("epoch") == e, order)).alias(e) for e in ("earlier", "later")]
    )


def split_frames(frames: DataFrame, extents: tuple[str, ...] = ("width", "height", "work_w", "work_h")) -> DataFrame:
    """Add ``reject_reason`` to frames with an extent below one pixel; null when usable.

    Tiling drops such frames, so list them from here.
    """
    there = [c for c in extents if c in frames.columns]
    usable = F.lit(True)
    for c in there:
        usable = usable & F.coalesce(F.col(c) >= 1, F.lit(False))
    return frames.withColumn("reject_reason", F.when(~usable, "no pixels"))


def working_frame(df: DataFrame, width="width", height="height", max_dim: int = K.FRAME_MAX_DIM) -> DataFrame:
    """Add work_w and work_h: the size both images of a pair are brought to."""
    w, h = shrink_to(F.col(width), F.col(height), max_dim)
    return df.withColumn("work_w", w).withColumn("work_h", h)


def fit_inside(df: DataFrame, width="width", height="height", bound: int = K.FIT_BOUND) -> DataFrame:
    """Add fit_w and fit_h: the size bounded by ``bound``, at least one pixel, never enlarged."""
    w, h = shrink_to(F.col(width), F.col(height), bound)
    one = F.lit(1).cast("bigint")
    return df.withColumn("fit_w", F.greatest(one, w)).withColumn("fit_h", F.greatest(one, h))


def plan_grid(
    df: DataFrame,
    width: str = "work_w",
    height: str = "work_h",
    tile_px: int = K.TILE_PX,
    max_tiles: int = K.MAX_TILES,
) -> DataFrame:
    """Add n_cols and n_rows; the longer direction loses lines until at most ``max_tiles`` remain."""
    one = F.lit(1).cast("bigint")

    def lines(extent: str) -> Column:
        return F.greatest(one, F.ceil(F.col(extent) / F.lit(float(tile_px))))

    def drop_line(grid: Column, _: Column) -> Column:
        over = grid["c"] * grid["r"] > max_tiles
        from_cols = over & (grid["c"] >= grid["r"]) & (grid["c"] > 1)
        from_rows = over & ~from_cols & (grid["r"] > 1)
        return F.struct(
            (grid["c"] - from_cols.cast("bigint")).alias("c"),
            (grid["r"] - from_rows.cast("bigint")).alias("r"),
        )

    start = F.struct(lines(width).alias("c"), lines(height).alias("r"))
    planned = df.withColumn("_grid", start).withColumn(
        "_grid",
        F.when(F.col("_grid.c") * F.col("_grid.r") <= max_tiles, F.col("_grid")).otherwise(
            F.aggregate(F.sequence(one, F.col("_grid.c") + F.col("_grid.r")), F.col("_grid"), drop_line)
        ),
    )
    return (
        planned.withColumn("n_cols", F.col("_grid.c")).withColumn("n_rows", F.col("_grid.r")).drop("_grid")
    )


def crop_size(sw: Column, sh: Column, max_px: Column | int) -> tuple[Column, Column]:
    """Output size of a crop: longer side at most ``max_px``, at least one pixel."""
    limit = F.lit(float(max_px)) if isinstance(max_px, int) else max_px.cast("double")
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(limit, F.greatest(sw, sh).cast("double")), F.lit(1.0)))
    one = F.lit(1).cast("bigint")
    return F.greatest(one, F.floor(sw * scale + 0.5)), F.greatest(one, F.floor(sh * scale + 0.5))


def explode_tiles(
    pairs: DataFrame,
    tile_px: int = K.TILE_PX,
    overlap: float = K.TILE_OVERLAP,
    max_tiles: int = K.MAX_TILES,
    max_tile_px: int = K.TILE_OUT_PX,
    overview_px: int = K.OVERVIEW_OUT_PX,
) -> DataFrame:
    """One row per task of a scene with work_w and work_h: the overview (task 0), then the tiles.

    A single generator emits all tasks, so the pairs are read once and nothing is shuffled. Tiles are
    row-major; every column of ``pairs`` is kept. Frames without a pixel give no task (see
    ``split_frames``).
    """
    grid = plan_grid(pairs.where("work_w >= 1 and work_h >= 1"), tile_px=tile_px, max_tiles=max_tiles)
    tasks = grid.withColumn(
        "task_idx", F.explode(F.sequence(F.lit(0), (F.col("n_cols") * F.col("n_rows")).cast("int")))
    )
    overview = F.col("task_idx") == 0
    cell = F.col("task_idx").cast("bigint") - 1
    row, col = F.floor(cell / F.col("n_cols")), F.pmod(cell, F.col("n_cols"))

    def span(i: Column, extent: str, count: str) -> tuple[Column, Column]:
        full = F.col(extent).cast("bigint")
        base = F.col(extent) / F.col(count)
        margin = base * F.lit(float(overlap))
        low = F.greatest(F.lit(0).cast("bigint"), F.floor(i * base - margin))
        high = F.least(full, F.ceil((i + 1) * base + margin))
        zero = F.lit(0).cast("bigint")
        return F.when(overview, zero).otherwise(low), F.when(overview, full).otherwise(high)

    x0, x1 = span(col, "work_w", "n_cols")
    y0, y1 = span(row, "work_h", "n_rows")
    placed = (
        tasks.withColumn("label", F.when(overview, "overview").otherwise(
            F.concat(F.lit("r"), (row + 1).cast("string"), F.lit("c"), (col + 1).cast("string"))))
        .withColumn("x0", x0).withColumn("y0", y0)
        .withColumn("sw", x1 - F.col("x0")).withColumn("sh", y1 - F.col("y0"))
    )
    out_w, out_h = crop_size(
        F.col("sw"), F.col("sh"), F.when(overview, F.lit(overview_px)).otherwise(F.lit(max_tile_px))
    )
    return (
        placed.withColumn("out_w", out_w).withColumn("out_h", out_h)
        .withColumn("gx", F.col("x0") / F.col("work_w")).withColumn("gy", F.col("y0") / F.col("work_h"))
        .withColumn("gw", F.col("sw") / F.col("work_w")).withColumn("gh", F.col("sh") / F.col("work_h"))
    )
