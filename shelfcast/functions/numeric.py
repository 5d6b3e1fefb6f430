"""Arithmetic with the conventions of the operators: null instead of errors on
division by zero, half-to-even rounding, truncating integer casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; null when ``den`` is zero."""
    return F.try_divide(num, den)


def half_even(col: Column, digits: int = 2) -> Column:
    return F.bround(col, digits)


def non_negative(col: Column) -> Column:
    return F.greatest(col, F.lit(0.0))


def truthy(cond: Column) -> Column:
    """A condition where unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def no_nan(col: Column) -> Column:
    """NaN marks a missing number in imported frames; inside Spark it is null."""
    return F.when(~F.isnan(col), col)


def whole_units(col: Column) -> Column:
    """A forecast as a whole, non-negative number of units."""
    return F.greatest(F.bround(col, 0).cast("bigint"), F.lit(0).cast("bigint"))
