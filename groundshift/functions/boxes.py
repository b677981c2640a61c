"""Column expressions over boxes given as struct columns with fields x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import clamp01

BOX_TYPE = "struct<x:double,y:double,w:double,h:double>"


def box(x="x", y="y", w="w", h="h") -> Column:
    """Pack four columns into a box."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (x, y, w, h)]
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(cols, "xywh")])


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    zero = F.lit(0.0)
    across = F.greatest(zero, F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    down = F.greatest(zero, F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inter = across * down
    union = area(a) + area(b) - inter
    return F.when(union <= 0, zero).otherwise(inter / union)


def clamp_box(values: Column) -> Column:
    """Turn up to four numbers into a box inside the unit square.

    A missing array or element counts as 0. A NaN position also empties the extent along its axis.
    """
    def raw(i: int) -> Column:
        return F.coalesce(F.get(values, F.lit(i)), F.lit(0.0))

    def axis(pos: Column, extent: Column) -> tuple[Column, Column]:
        start = F.when(F.isnan(pos), F.lit(0.0)).otherwise(clamp01(pos))
        length = F.when(F.isnan(pos) | F.isnan(extent), F.lit(0.0)).otherwise(
            F.least(F.greatest(extent, F.lit(0.0)), F.lit(1.0) - start)
        )
        return start, length

    x, w = axis(raw(0), raw(2))
    y, h = axis(raw(1), raw(3))
    return box(x, y, w, h)


def to_scene(b: Column, tile: Column) -> Column:
    """Map a tile-local box to scene coordinates; ``tile`` has gx, gy, gw, gh."""
    x = clamp01(tile["gx"] + b["x"] * tile["gw"])
    y = clamp01(tile["gy"] + b["y"] * tile["gh"])
    return box(
        x, y,
        F.least(b["w"] * tile["gw"], F.lit(1.0) - x),
        F.least(b["h"] * tile["gh"], F.lit(1.0) - y),
    )


def to_pixels(b: Column, px: int, width: Column, height: Column) -> Column:
    """Scale a box to an image drawn ``px`` wide; the aspect ratio falls back to 1."""
    ratio = F.when((width > 0) & (height > 0), width / height).otherwise(F.lit(1.0))
    rows = F.floor(F.lit(float(px)) / ratio + 0.5).cast("double")
    wide = F.lit(float(px))
    return box(b["x"] * wide, b["y"] * rows, b["w"] * wide, b["h"] * rows)


def to_percent(b: Column) -> Column:
    hundred = F.lit(100.0)
    return box(b["x"] * hundred, b["y"] * hundred, b["w"] * hundred, b["h"] * hundred)
