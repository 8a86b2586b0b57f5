"""Small numeric expressions."""

from pyspark.sql import Column, functions as F


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, F.lit(1.0)))


def half_up(value: Column, digits: int) -> Column:
    """Round a non-negative double with plain arithmetic, the same in every engine."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def settled(value: Column, digits: int) -> Column:
    """Half-up rounding of an average: noise from the order of summation is rounded off first."""
    return half_up(half_up(value, 9), digits)


def half_even(value: Column) -> Column:
    """Round to a whole number, halves to the even neighbour."""
    return F.bround(value.cast("double"), 0).cast("int")
