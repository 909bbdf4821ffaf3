"""Rounding and division with the semantics the scorecards are defined in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double.

    ``F.round(x, n)`` rounds the decimal text of a double (1.005 -> 1.01). The scorecards scale
    first and round to a whole number (1.005 -> 100.49999999999999 -> 1.0).
    """
    scale = float(10**digits)
    return F.round(value.cast("double") * F.lit(scale)) / F.lit(scale)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating division that yields NULL on a zero or NULL divisor instead of raising."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def printf_round(value: Column, digits: int) -> Column:
    """Round a double the way ``printf("%.nf")`` does: on its exact binary value, ties to even.

    Java's formatter rounds the shortest decimal text instead, so 37.65 (stored slightly below)
    would print as 37.7. The distance to the half-way point is computed without rounding error by
    splitting the value into a multiple of 2^-20 and a remainder. Meant for values below 2^26.
    """
    magnitude = F.abs(value.cast("double"))
    grid = F.lit(float(2**20))
    high = F.floor(magnitude * grid).cast("double") / grid
    low = magnitude - high
    doubled = F.lit(2.0 * 10**digits)
    below = F.floor(magnitude * F.lit(float(10**digits))).cast("double")
    past_half = (high * doubled - (below * 2 + 1)) + low * doubled
    up = (past_half > 0) | ((past_half == 0) & (below % 2 == 1))
    rounded = (below + up.cast("double")) / F.lit(float(10**digits))
    return F.when(value < 0, -rounded).otherwise(rounded)
