"""Per-frame pixel work on array columns: one row is one frame, so nothing is shuffled."""

from pyspark.sql import Column, functions as F


def code_count(mask: Column, code: int) -> Column:
    return F.size(F.filter(mask, lambda value: value == code))


def sorted_quantile(ordered: Column, p: float) -> Column:
    """Linear interpolation in an ascending array."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    below = F.get(ordered, low)
    above = F.coalesce(F.get(ordered, low + 1), below)
    return below + (above - below) * (at - low)
