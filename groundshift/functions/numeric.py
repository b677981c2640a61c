"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp01(value: Column) -> Column:
    """Limit a non-null value to [0, 1]."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def round_half_up(value: Column) -> Column:
    """Round with ties towards plus infinity (Spark's ``round`` moves ties away from zero)."""
    return F.floor(value + F.lit(0.5))


def shrink_to(width: Column, height: Column, bound: int | float) -> tuple[Column, Column]:
    """Scale a size so that its longer side is at most ``bound``; never enlarge. Sizes below 1 stay as they are."""
    longest, limit = F.greatest(width, height).cast("double"), F.lit(float(bound))
    scale = F.when(longest > limit, F.try_divide(limit, longest)).otherwise(1.0)
    return round_half_up(width * scale), round_half_up(height * scale)
