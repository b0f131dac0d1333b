"""Argument coercion and rounding shared by the scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """Names become columns, columns stay, other values become literals."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def dbl(x) -> Column:
    return col(x).cast("double")


def half_even(x) -> Column:
    """Nearest whole number, ties to even, as a long."""
    return F.bround(dbl(x), 0).cast("long")


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(dbl(x), dbl(lo)), dbl(hi))


def round_scaled(x, digits: int) -> Column:
    """Nearest multiple of 10^-digits of the scaled binary value, ties away from zero.

    ``F.round`` rounds the shortest decimal text of a double instead, which turns 1.035 (a little less in
    binary) into 1.04.
    """
    scale = float(10**digits)
    return F.round(dbl(x) * scale, 0) / scale
