"""Distinct counts over any range of days from stored sketches.

Every day, and every day of a store, keeps a HyperLogLog sketch of the keys it saw; sketches of
any days unite, so a count over a range reads a few bytes a day instead of the rows, and a new day
only adds its own.  Repeats of a day's rows change nothing.  The exact counts of ``overview`` and
``validate`` stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers.
REGISTERS = 12


def relative_error(registers: int = REGISTERS) -> float:
    """Three standard errors of a united sketch, as a share of the count."""
    return 3 * 1.04 / 2 ** (registers / 2)


def _key(columns: str | Sequence[str]) -> Column:
    """Several columns as one value; a null in any counts as no key."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    # Lengths keep ('ab', 'c') and ('a', 'bc') apart.
    parts = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in columns]
    return F.concat(*parts)


def daily_sketches(
    rows: DataFrame, counted: dict[str, str | Sequence[str]], *, by: Sequence[str] = (), registers: int = REGISTERS
) -> DataFrame:
    """``(date, by, rows, <name>...)``: how many rows a day has, and a sketch of each counted key.

    One aggregate with map-side combine: a busy day leaves each task as one row.
    """
    kept = [F.hll_sketch_agg(_key(c), registers).alias(name) for name, c in counted.items()]
    return rows.groupBy("date", *by).agg(F.count(F.lit(1)).alias("rows"), *kept)


def distinct_between(
    sketches: DataFrame, names: Sequence[str], *, first: date | None = None, last: date | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """``(by, rows, <name>...)``: estimated distinct keys of the days from ``first`` to ``last``, both included."""
    if first is not None:
        sketches = sketches.where(F.col("date") >= F.lit(first))
    if last is not None:
        sketches = sketches.where(F.col("date") <= F.lit(last))
    unions = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(n)), F.lit(0)).alias(n) for n in names]
    return sketches.groupBy(*by).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *unions)
