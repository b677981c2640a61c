"""Removal of overlapping duplicates, reading order and ids.

Within a scene, boxes are visited by confidence rank, then area (both descending), then input order
(task_idx, pos). A box is dropped when an already kept box of the same change type overlaps it with
IoU above the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions.boxes import area, box, iou
from ..session import stored
from .geometry import CELL, OverlapCells, has_extent
from .skew import HOT_ROWS, number_hot_rows, number_rows, shuffled, split_hot

# Rows that one task visits at once.
VISIT_ROWS = 2048
# Rows of a visit compared with all later ones at once.
PAIR_ROWS = 256
SALTS = 8
GROUP = ["scene_id", "change_type"]
ORDER = ["_rank", "_area", "task_idx", "pos"]


def confidence_rank(confidence: Column) -> Column:
    """0, 1, 2 for low, medium, high; null for anything else."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(K.CONFIDENCES):
        rank = F.when(confidence == name, F.lit(i)).otherwise(rank)
    return rank


def priority_order() -> list[Column]:
    """Sort columns of the visiting order; (task_idx, pos) makes it total within a scene."""
    rank = F.coalesce(confidence_rank(F.col("confidence")), F.lit(0))
    return [rank.desc(), (F.col("w") * F.col("h")).desc(), F.col("task_idx").asc(), F.col("pos").asc()]


def with_priority(det: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Add ``priority``, 1 for the box of a scene that is visited first."""
    return number_rows(det, ["scene_id"], priority_order(), "priority", limit)


def reading_order() -> list[Column]:
    """Top to bottom, left to right, ties in visiting order."""
    return [F.col("y").asc(), F.col("x").asc(), *priority_order()]


def number_changes(kept: DataFrame, limit: int = HOT_ROWS, check_hot: bool = True) -> DataFrame:
    """Add ``n`` in reading order and ``id`` = 'chg-n'. Filters that run later keep these numbers."""
    return _with_id(number_rows(kept, ["scene_id"], reading_order(), "n", limit, check_hot))


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.concat(F.lit("chg-"), F.col("n").cast("string")))


def dedupe(
    det: DataFrame, threshold: float = K.DEDUPE_IOU, strategy: str = "auto", limit: int = HOT_ROWS
) -> DataFrame:
    """Keep the boxes that no kept box of the same type suppresses.

    ``fold`` visits each (scene, type) group inside one row; ``rounds`` decides boxes in parallel
    rounds and bounds what any task holds; ``auto`` folds scenes of up to ``limit`` boxes and runs
    rounds on larger ones. All three return the same rows.
    """
    if strategy == "fold":
        return _fold(det, threshold)
    if strategy == "rounds":
        return _rounds(det, threshold, limit)
    if strategy != "auto":
        raise ValueError(f"unknown strategy {strategy!r}")
    split = split_hot(det, ["scene_id"], limit)
    cold = _fold(split.cold, threshold)
    return cold if split.hot is None else cold.unionByName(_rounds(split.hot, threshold, limit))


def merge_detections(det: DataFrame, threshold: float = K.DEDUPE_IOU, limit: int = HOT_ROWS) -> DataFrame:
    """Dedupe and number. Ordinary scenes are shuffled once, by scene, for both steps."""
    split = split_hot(det, ["scene_id"], limit)
    cold = number_changes(_fold(split.cold, threshold), check_hot=False)
    if split.hot is None:
        return cold
    hot = number_hot_rows(
        _rounds(split.hot, threshold, limit), ["scene_id"], reading_order(), "n", split.hot_rows, limit
    )
    return cold.unionByName(_with_id(hot))


def _ranked(det: DataFrame) -> DataFrame:
    """Pack rows as (scene_id, change_type, row); comparing ``row`` gives the visiting order."""
    rest = [c for c in det.columns if c not in ("task_idx", "pos", *GROUP)]
    rank = F.coalesce(confidence_rank(F.col("confidence")), F.lit(0))
    row = F.struct(
        (-rank).alias("_rank"), (-area(box())).alias("_area"), "task_idx", "pos", box().alias("_box"), *rest
    )
    return det.select(*GROUP, row.alias("row"))


def _unpack(rows: DataFrame, columns: list[str]) -> DataFrame:
    # The group columns are taken as they are, so that the partitioning by scene stays known.
    return rows.select(*[F.col(c) if c in GROUP else F.col(f"row.{c}").alias(c) for c in columns])


def _fold(det: DataFrame, threshold: float) -> DataFrame:
    # Partitioning by scene also serves the window that numbers the result.
    return _unpack(_fold_rows(_ranked(det).repartition("scene_id"), threshold), det.columns)


def _fold_rows(ranked: DataFrame, threshold: float) -> DataFrame:
    def visit(kept: Column, row: Column) -> Column:
        hit = F.exists(kept, lambda k: iou(k["_box"], row["_box"]) > threshold)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(row)))

    groups = ranked.groupBy(*GROUP).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    empty = F.filter("rows", lambda _: F.lit(False))
    return groups.select(*GROUP, F.explode(F.aggregate("rows", empty, visit)).alias("row"))


def _rounds(det: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Decide boxes in rounds until every group that is left is small enough for one visit.

    A round visits coarse cells one by one, each with the boxes around it. A box of the cell is kept or dropped as the
    sequential visit would do, or stays open where that depends on a box whose fate another cell decides. The result is
    that of the sequential visit, because only certain decisions are taken, and the first open box of a group is always certain.
    Cells grow from round to round while they hold few boxes, so chains of boxes advance by whole cells.

    Whole rows are written once and shuffled once more at the end; rounds move and store boxes, order and row numbers only.
    """
    cells = OverlapCells(threshold)
    ranked = _ranked(det)
    b = F.col("row._box")
    isolated = ranked.where(~has_extent(b))
    extended = ranked.where(has_extent(b))
    # Exact copies share every overlap, so only the first of them can survive.
    copies = iou(b, b) > threshold
    first = (
        extended.where(copies)
        .groupBy(*GROUP, F.col("row._box").alias("_box")).agg(F.min("row").alias("row"))
        .select(*GROUP, "row")
    )
    whole = stored(first.unionByName(extended.where(~copies)).withColumn("rid", F.monotonically_increasing_id()), "boxes")
    order = F.struct(*[F.col(f"row.{c}").alias(c) for c in ORDER])
    open_rows = cells.file(whole.select(*GROUP, "rid", order.alias("_o"), F.col("row._box").alias("b")), F.col("b")).withColumn(
        "salt", F.pmod(F.hash("_o.task_idx", "_o.pos"), F.lit(SALTS)))
    kept = []
    halvings = 3
    while True:
        sizes = open_rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size"))
        least, most = sizes.agg(F.min("size"), F.max("size")).first()
        if most is None or most <= limit:
            kept.append(_visit(open_rows.withColumn("own", F.lit(True)), GROUP, threshold).where("kept").select("rid"))
            break
        if least <= limit:
            large = sizes.where(F.col("size") > limit).select(*[F.col(c).alias(f"l_{c}") for c in GROUP])
            small = open_rows.join(large, _same_group("l_"), "left_anti").withColumn("own", F.lit(True))
            kept.append(_visit(small, GROUP, threshold).where("kept").select("rid"))
            open_rows = open_rows.join(large, _same_group("l_"), "left_semi")
        decided = stored(_visit_cells(open_rows, cells, halvings), "decided")
        kept.append(decided.where("kept").select("rid"))
        undecided = open_rows.join(shuffled(decided), "rid", "left_anti")
        # A cell that was cut has not met all rows that its kept boxes suppress.
        cut = decided.where("kept and cut").select("rid")
        if not cut.isEmpty():
            undecided = _remaining(undecided, open_rows.join(shuffled(cut), "rid", "left_semi"), cells)
        open_rows = stored(undecided, "open")
        coarse = [F.shiftright(c, halvings) if c in ("cx", "cy") else F.col(c) for c in CELL]
        filled = open_rows.groupBy(*GROUP, *coarse).agg(F.count(F.lit(1)).alias("n"))
        mean = filled.agg(F.avg("n")).first()[0] or 0.0
        halvings = min(halvings + 2, 48) if mean < VISIT_ROWS else max(halvings - 1, 0)
    rids = kept[0]
    for part in kept[1:]:
        rids = rids.unionByName(part)
    # Row numbers come out of Python steps, whose size Spark does not know.
    picked = whole.join(shuffled(rids), "rid", "left_semi").select(*GROUP, "row")
    return _unpack(isolated.unionByName(picked), det.columns)


def _same_group(prefix: str) -> Column:
    """Equal group columns, missing ones included."""
    same = F.lit(True)
    for c in GROUP:
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return same


def _visit_cells(open_rows: DataFrame, cells: OverlapCells, halvings: int) -> DataFrame:
    """Decisions (rid, kept, cut) on open rows from a visit of every coarse cell; certain ones only.

    A cell holds its own rows and those around it that can overlap them, so all rows that a kept one suppresses are there, whatever
    their own cell. It visits the first VISIT_ROWS of them: a row depends on earlier ones only, so later rows can wait. The limit on
    the row number applies before the shuffle.
    """
    brief = open_rows.select(*GROUP, "rid", "_o", "b", *[F.col(c).alias(f"o_{c}") for c in CELL])
    placed = cells.around(brief, F.col("b"), halvings)
    own = (F.col("kw") == F.col("o_kw")) & (F.col("kh") == F.col("o_kh"))
    for c in ("cx", "cy"):
        own = own & (F.col(c) == F.shiftright(f"o_{c}", halvings))
    visited = _visit(placed.withColumn("own", own), [*GROUP, *CELL], cells.threshold, VISIT_ROWS)
    return visited.groupBy("rid").agg(F.max("kept").alias("kept"), F.max("cut").alias("cut"))


def _visit(rows: DataFrame, place: list[str], threshold: float, most: int | None = None) -> DataFrame:
    """Decisions (rid, kept, cut) that the sequential visit of each place makes for certain, in the first ``most`` rows.

    Rows marked ``own`` are kept or dropped, others only dropped; the rest is not listed. ``cut`` says that the place has later rows.
    """
    brief = rows.select(*place, "rid", "own", "_o", *[F.col(f"b.{c}").alias(c) for c in "xywh"])
    order = [F.col(f"_o.{c}") for c in ORDER]
    numbered = brief.withColumn("_n", F.row_number().over(W.partitionBy(*place).orderBy(*order)))
    if most is not None:
        numbered = numbered.where(F.col("_n") <= most + 1)
    sorted_rows = numbered.sortWithinPartitions(*place, "_n")
    return sorted_rows.select("_n", "rid", "own", *"xywh").mapInArrow(_visitor(threshold, most), "rid long, kept boolean, cut boolean")


def _visitor(threshold: float, most: int | None):
    """mapInArrow over places one after the other, each starting at ``_n`` = 1."""

    def certain(own: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(own)
        dropped, waits = np.zeros(n, bool), np.zeros(n, bool)
        right, low, size = x + w, y + h, w * h
        for lo in range(0, n if own.any() else 0, PAIR_ROWS):
            rows, later = lo + np.flatnonzero(~dropped[lo:lo + PAIR_ROWS]), slice(lo, n)
            at = rows[:, None]
            across = np.maximum(0.0, np.minimum(right[at], right[later]) - np.maximum(x[at], x[later]))
            down = np.maximum(0.0, np.minimum(low[at], low[later]) - np.maximum(y[at], y[later]))
            inter = across * down
            union = size[at] + size[later] - inter
            hit = np.divide(inter, union, out=np.zeros(inter.shape), where=union > 0) > threshold
            hit &= np.arange(lo, n) > at
            some = hit.any(axis=1)
            for i, hits in zip(rows[some].tolist(), hit[some], strict=True):
                if not dropped[i]:
                    (dropped if own[i] and not waits[i] else waits)[later] |= hits
        return own & ~waits & ~dropped, dropped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[list[np.ndarray]] = []
        nothing = [np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)]

        def close() -> list[np.ndarray]:
            if not pending:
                return nothing
            rid, *rest = [np.concatenate(parts)[:most] for parts in zip(*pending, strict=True)]
            cut = most is not None and sum(len(parts[0]) for parts in pending) > most
            pending.clear()
            kept, dropped = certain(*rest)
            listed = kept | dropped
            return [rid[listed], kept[listed], np.full(listed.sum(), cut)]

        def decisions(found: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(parts)) for parts in zip(nothing, *found, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["rid", "kept", "cut"])

        for batch in batches:
            number, *columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            starts = np.flatnonzero(number == 1).tolist()
            found = []
            for lo, hi in zip([0, *starts], [*starts, len(number)], strict=True):
                if hi > lo:
                    if number[lo] == 1:
                        found.append(close())
                    pending.append([c[lo:hi] for c in columns])
            yield decisions(found)
        yield decisions([close()])

    return run


def _remaining(open_rows: DataFrame, safe: DataFrame, cells: OverlapCells) -> DataFrame:
    """Undecided rows without those that the rows just kept suppress.

    Kept rows are spread over the cells and salts around them; undecided rows stay in place, so a
    crowded cell is shared by SALTS tasks.
    """
    boxes = safe.select(
        *GROUP, F.col("b").alias("k_box"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    place = [*CELL, "salt"]
    reach = cells.around(boxes, F.col("k_box")).withColumnsRenamed({c: f"k_{c}" for c in [*GROUP, *place]})
    hit = _same_group("k_") & (iou(F.col("b"), F.col("k_box")) > cells.threshold)
    for c in place:
        hit = hit & (F.col(c) == F.col(f"k_{c}"))
    return open_rows.join(reach, hit, "left_anti")


__all__ = [
    "confidence_rank", "dedupe", "merge_detections", "number_changes", "number_rows", "priority_order",
    "reading_order", "with_priority",
]
