"""Boxes against tiles, against each other and against points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.boxes import BOX_TYPE, box, iou, to_percent, to_pixels, to_scene
from ..session import ensure_checkpoint_dir
from .skew import crowded_parts, deal_parts, shuffled

BOX_FIELDS = list("xywh")


def map_to_global(det: DataFrame, tiles: DataFrame) -> DataFrame:
    """Replace tile-local x, y, w, h by scene coordinates.

    Joins on (scene_id, task_idx) by shuffle, with only the four tile fractions on the right. Rows that carry
    gx, gy, gw, gh already should use ``map_in_place``, which needs no join.
    """
    fractions = tiles.select("scene_id", "task_idx", "gx", "gy", "gw", "gh")
    return map_in_place(det.join(shuffled(fractions), ["scene_id", "task_idx"]))


def map_in_place(det: DataFrame) -> DataFrame:
    """Map boxes of rows that carry the fractions of their tile."""
    tile = F.struct("gx", "gy", "gw", "gh")
    keep = [c for c in det.columns if c not in ("gx", "gy", "gw", "gh", *BOX_FIELDS)]
    return det.withColumn("_g", to_scene(box(), tile)).select(*keep, *[F.col(f"_g.{n}").alias(n) for n in BOX_FIELDS])


def rescale_boxes(df: DataFrame, px: int = 1000, width: str = "width", height: str = "height") -> DataFrame:
    """Add pixel boxes (px_*) for an image drawn ``px`` wide, and percent boxes (pct_*)."""
    out = df.withColumn("_px", to_pixels(box(), px, F.col(width), F.col(height))).withColumn("_pct", to_percent(box()))
    return out.select(
        *df.columns,
        *[F.col(f"_px.{n}").alias(f"px_{n}") for n in BOX_FIELDS],
        *[F.col(f"_pct.{n}").alias(f"pct_{n}") for n in BOX_FIELDS],
    )


# --- overlap cells -------------------------------------------------------------------
#
# IoU(a, b) > t implies, per axis, that the extents differ by a factor below 1/t and that the starts
# differ by less than (1 - t) * max(extent). So a box is filed under one cell (extent class, start
# position at the pitch of that class), and every partner lies in a small set of cells around it.


CELL = ["kw", "cx", "kh", "cy"]


class OverlapCells:
    """Cells such that boxes with IoU above ``threshold`` can be found by equality of cells.

    A cell is four plain columns, and all steps are codegen expressions and explodes of sequences.
    """

    def __init__(self, threshold: float):
        if not 0.0 < threshold < 1.0:
            raise ValueError("threshold must lie strictly between 0 and 1")
        self.threshold = threshold
        self.base = threshold ** -2

    def _class(self, extent: Column, shift: float = 0.0) -> Column:
        return F.floor(F.log(extent) / F.lit(math.log(self.base)) + F.lit(shift)).cast("int")

    def _pitch(self, cls: Column) -> Column:
        return F.pow(F.lit(self.base), (cls + 1).cast("double"))

    def file(self, df: DataFrame, b: Column) -> DataFrame:
        """Add the cell of a box with positive extents."""
        filed = df.withColumn("kw", self._class(b["w"])).withColumn("kh", self._class(b["h"]))
        return filed.withColumn("cx", F.floor(b["x"] / self._pitch(F.col("kw")))).withColumn(
            "cy", F.floor(b["y"] / self._pitch(F.col("kh")))
        )

    def classes_around(self, df: DataFrame, b: Column) -> DataFrame:
        """One row per pair of extent classes that partners of a box can have."""
        def near(extent: Column) -> Column:
            # Half a class either way, and a little more against rounding at the class borders.
            return F.sequence(self._class(extent, -0.5 - 1e-9), self._class(extent, 0.5 + 1e-9))

        return df.withColumn("kw", F.explode(near(b["w"]))).withColumn("kh", F.explode(near(b["h"])))

    def places_around(
        self, df: DataFrame, start: Column, extent: Column, cls: str, out: str, halvings: int = 0
    ) -> DataFrame:
        """One row per position of class ``cls`` that partners can have along one axis."""
        pitch = self._pitch(F.col(cls))
        longest = F.greatest(extent, F.least(extent / F.lit(self.threshold), pitch))
        reach = F.lit((1.0 - self.threshold) * (1.0 + 1e-9)) * longest
        ends = [F.shiftright(F.floor(end / pitch), halvings) for end in (start - reach, start + reach)]
        return df.withColumn(out, F.explode(F.sequence(*ends)))

    def around(self, df: DataFrame, b: Column, halvings: int = 0) -> DataFrame:
        """One row per cell in which partners of a box can lie.

        With ``halvings`` cells are taken together, 2 ** halvings along either axis, and positions are halved as often.
        """
        spread = self.places_around(self.classes_around(df, b), b["x"], b["w"], "kw", "cx", halvings)
        return self.places_around(spread, b["y"], b["h"], "kh", "cy", halvings)


def has_extent(b: Column) -> Column:
    """Boxes without extent overlap nothing."""
    return (b["w"] > 0) & (b["h"] > 0)


# Distinct boxes of one overlap cell beyond which its pairs are compared in several tasks.
CROWDED_BOXES = 2048


def iou_pairs(boxes: DataFrame, threshold: float = K.DEDUPE_IOU, crowded: int = CROWDED_BOXES) -> DataFrame:
    """Overlapping pairs of boxes of one scene and change type, over distinct boxes.

    Copies of one box are counted before the join (a_n, b_n), so a group of copies contributes one
    row per partner instead of the product of its sizes: a pair stands for a_n * b_n detections, and a
    row that pairs a box with itself for its a_n copies. ``a`` is the smaller box in (x, y, w, h) order.
    Cells with more than ``crowded`` distinct boxes are cut into parts on both sides, and every part of one side meets every
    part of the other in a key of its own, so a crowd is compared by many tasks.
    """
    cells = OverlapCells(threshold)
    ensure_checkpoint_dir(boxes.sparkSession)
    keys = ["scene_id", "change_type"]
    distinct = (
        boxes.where(has_extent(box()))
        .groupBy(*keys, *BOX_FIELDS).agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, box().alias("b"), "n")
    )
    # Counted and read by both sides.
    filed = cells.file(distinct, F.col("b")).checkpoint()
    # A pair is found once: from its box of the higher extent class, or from the left one of a class.
    own = filed.select(*keys, F.col("b").alias("p"), F.col("n").alias("p_n"), F.col("kw").alias("p_kw"),
                       F.col("kh").alias("p_kh"), F.col("cx").alias("p_cx"))
    lower = (F.col("kw") < F.col("p_kw")) | ((F.col("kw") == F.col("p_kw")) & (F.col("kh") < F.col("p_kh")))
    equal = (F.col("kw") == F.col("p_kw")) & (F.col("kh") == F.col("p_kh"))
    p, q = F.col("p"), F.col("q")
    across = cells.places_around(
        cells.classes_around(own, p).where(lower | equal), p["x"], p["w"], "kw", "cx"
    ).where(lower | (F.col("cx") >= F.col("p_cx")))
    left = cells.places_around(across, p["y"], p["h"], "kh", "cy").withColumn("lower", lower).drop("p_kw", "p_kh", "p_cx")
    right = filed.select(*keys, F.col("b").alias("q"), F.col("n").alias("q_n"), *CELL)
    once = F.col("lower") | (p < q) | ((p == q) & (F.col("p_n") > 1))
    place = [*keys, *CELL]
    crowds = crowded_parts(filed, place, crowded)
    if crowds is not None:
        left = deal_parts(left, crowds, place, "left_part", "right_part", p)
        right = deal_parts(right, crowds, place, "right_part", "left_part", q)
        place = [*place, "left_part", "right_part"]
        # The work follows pairs, not bytes, so partitions must not be merged for being small.
        n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(n, *place), right.repartition(n, *place)
    found = left.join(right, place).where(once & (iou(p, q) > threshold))
    ordered = p <= q

    def side(low: str, high: str) -> Column:
        return F.when(ordered, F.col(low)).otherwise(F.col(high))

    return found.select(
        *keys, side("p", "q").alias("a"), side("p_n", "q_n").alias("a_n"),
        side("q", "p").alias("b"), side("q_n", "p_n").alias("b_n"),
    ).select(
        *keys, *[F.col(f"a.{f}").alias(f"a_{f}") for f in BOX_FIELDS], "a_n",
        *[F.col(f"b.{f}").alias(f"b_{f}") for f in BOX_FIELDS], "b_n", iou(F.col("a"), F.col("b")).alias("iou"),
    )


# --- spotlight -----------------------------------------------------------------------


# Points, or pieces of boxes, of one cell beyond which it is cut into sixteen, and how often that may happen.
CROWDED_CELL = 20_000
DESCENTS = 4


def lit_points(points: DataFrame, boxes: DataFrame, cells: int = 16, crowded: int = CROWDED_CELL) -> DataFrame:
    """Points (scene_id, px, py) inside any visible box of their scene."""
    return _spotlight(points, boxes, cells, "left_semi", crowded)


def dim_points(points: DataFrame, boxes: DataFrame, cells: int = 16, crowded: int = CROWDED_CELL) -> DataFrame:
    """Points outside every visible box of their scene."""
    return _spotlight(points, boxes, cells, "left_anti", crowded)


def _pieces(spans: DataFrame, cells: int) -> DataFrame:
    """Spans (scene_id, x0, y0, x1, y1) clipped to the cells they touch; equal pieces collapse, ``whole`` ones cover their cell."""
    n = F.lit(float(cells))
    last = F.lit(cells - 1).cast("bigint")

    def touched(low: str, high: str) -> Column:
        lo = F.greatest(F.lit(0).cast("bigint"), F.floor(F.col(low) * n))
        hi = F.least(last, F.ceil(F.col(high) * n) - 1)
        return F.explode(F.filter(F.sequence(F.least(lo, last), F.greatest(hi, F.least(lo, last))), lambda c: c <= hi))

    def clipped(cell: str, low: str, high: str) -> list[Column]:
        return [F.greatest(F.col(cell) / n, F.col(low)).alias(low), F.least((F.col(cell) + 1) / n, F.col(high)).alias(high)]

    spread = spans.withColumn("cx", touched("x0", "x1")).withColumn("cy", touched("y0", "y1"))
    whole = (
        (F.col("x0") == F.col("cx") / n) & (F.col("x1") == (F.col("cx") + 1) / n)
        & (F.col("y0") == F.col("cy") / n) & (F.col("y1") == (F.col("cy") + 1) / n)
    )
    return spread.select(*PLACE, *clipped("cx", "x0", "x1"), *clipped("cy", "y0", "y1")).distinct().withColumn("whole", whole)


PLACE = ["scene_id", "cx", "cy"]


def crowded_cells(located: DataFrame, parts: DataFrame, limit: int) -> DataFrame:
    """Cells with partial pieces that hold more than ``limit`` points or pieces; both are counted before the shuffle."""
    points = located.groupBy("scene_id", F.col("_cx").alias("cx"), F.col("_cy").alias("cy")).agg(F.count(F.lit(1)).alias("p"))
    pieces = parts.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("b"))
    return points.join(pieces, PLACE).where((F.col("p") > limit) | (F.col("b") > limit)).select(*PLACE)


def _spotlight(points: DataFrame, boxes: DataFrame, cells: int, how: str, crowded: int) -> DataFrame:
    """Existence join on the cells of a quadtree over the unit square; no pair is ever emitted.

    Boxes are clipped to the cells they touch. A cell that one box covers wholly keeps that single entry. Cells
    start at ``cells`` by ``cells``; a partly covered one with more than ``crowded`` points or pieces is cut into sixteen, and only its
    points and pieces go down with it, so a scene with very many of either spreads over as many cells as it needs. Points that
    share one place cannot be parted; there AQE splits the join. Boxes are half open: x <= px < x + w.
    """
    visible = boxes.where(has_extent(box()))
    if "visible" in boxes.columns:
        visible = visible.where("visible")
    spans = visible.select(
        "scene_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"),
        (F.col("y") + F.col("h")).alias("y1"),
    )
    columns, rest, out = points.columns, points, None
    for descent in range(DESCENTS + 1):
        n = F.lit(float(cells * 4 ** descent))
        last = F.lit(cells * 4 ** descent - 1).cast("bigint")
        pieces = _pieces(spans, cells * 4 ** descent)
        full = pieces.where("whole")
        parts = pieces.where(~F.col("whole")).join(full.select(*PLACE), PLACE, "left_anti")
        located = rest.withColumn("_cx", F.least(last, F.floor(F.col("px") * n))).withColumn(
            "_cy", F.least(last, F.floor(F.col("py") * n))
        )
        deeper = None
        if descent < DESCENTS:
            ensure_checkpoint_dir(points.sparkSession)
            deeper = crowded_cells(located, parts, crowded).checkpoint()
            deeper = None if deeper.isEmpty() else deeper
        here, targets = located, full.unionByName(parts)
        if deeper is not None:
            at = [F.col("scene_id"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy")]
            names = ["scene_id", "_cx", "_cy"]
            here = located.join(deeper.select(*at), names, "left_anti")
            rest = located.join(deeper.select(*at), names, "left_semi").select(*columns).checkpoint()
            spans = parts.join(deeper, PLACE, "left_semi").select("scene_id", "x0", "y0", "x1", "y1").checkpoint()
        p, t = here.alias("p"), targets.alias("t")
        inside = (
            (F.col("p.scene_id") == F.col("t.scene_id")) & (F.col("p._cx") == F.col("t.cx"))
            & (F.col("p._cy") == F.col("t.cy"))
            & (F.col("p.px") >= F.col("t.x0")) & (F.col("p.px") < F.col("t.x1"))
            & (F.col("p.py") >= F.col("t.y0")) & (F.col("p.py") < F.col("t.y1"))
        )
        found = p.join(t, inside, how).select(*[F.col(f"p.{c}") for c in columns])
        out = found if out is None else out.unionByName(found)
        if deeper is None:
            return out
    return out


__all__ = [
    "BOX_TYPE", "CELL", "OverlapCells", "crowded_cells", "dim_points", "has_extent", "iou_pairs", "lit_points", "map_in_place",
    "map_to_global", "rescale_boxes",
]
