"""Column expressions over pixel samples."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import round_half_up

# fixed values: luma weights of the public RGB to grey formula
RED, GREEN, BLUE = 0.299, 0.587, 0.114


def to_grey(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(RED) + g * F.lit(GREEN) + b * F.lit(BLUE)


def u16_to_u8(value: Column) -> Column:
    return F.shiftright(value.cast("int"), 8)


def stretch_u8(value: Column, low: Column, high: Column) -> Column:
    """Min-max stretch to 0..255; a flat range counts as 1 and NaN becomes 0."""
    span = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    scaled = round_half_up((value - low) / span * F.lit(255.0)).cast("int")
    return F.when(F.isnan(value) | value.isNull() | low.isNull(), F.lit(0)).otherwise(scaled)
