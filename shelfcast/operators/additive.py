"""An additive model of every series: trend, seasons and promotion, fitted jointly (M4).

A piecewise-linear trend, Fourier terms of the week and the year and the promotion are the
terms of one ridge regression per series.  What a series knows of it is its Gram matrix, the sums of
products of terms, so fitting is an aggregate: every task sums the matrices of the rows it holds and only those
move.  Matrices over the same stretch of time add up, so stored ones take in new days without
the old rows.  Each series' small system is solved on Arrow batches; forecasts are plain columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES
from shelfcast.functions.numeric import non_negative

# History needed by the seasonal parts, in days.
WEEKLY_AFTER_DAYS = 14
YEARLY_AFTER_DAYS = 365

#: Bends of the trend, evenly spaced over the first 80 % of the stretch; waves of the week and the year.
BENDS, BENDS_UNTIL, WEEK_WAVES, YEAR_WAVES = 6, 0.8, 3, 4
YEAR = 365.25

#: Ridge penalties per learnt row: slope, bends, waves, promotion.  The level has none.
SLOPE, BEND, WAVE, PROMOTION = 0.01, 0.02, 0.05, 0.001
PENALTIES = [0.0, SLOPE, *[BEND] * BENDS, *[WAVE] * (2 * WEEK_WAVES + 2 * YEAR_WAVES), PROMOTION]

SIZE = len(PENALTIES)
WEEKLY = slice(2 + BENDS, 2 + BENDS + 2 * WEEK_WAVES)
YEARLY = slice(WEEKLY.stop, WEEKLY.stop + 2 * YEAR_WAVES)
_SYSTEM = SIZE * (SIZE + 1)  # products of terms, and of terms with sales

#: Series a task sums at once; more are passed on and summed after the shuffle.
HELD_SERIES = 2048


def place(date: Column | str, first: Column, last: Column) -> Column:
    """A day's place in the learnt stretch: 0 on its first day, 1 on its last."""
    days = F.greatest(F.datediff(last, first), F.lit(1)).cast("double")
    return F.datediff(date, first).cast("double") / days


def terms(date: Column | str, promotion: Column, first: Column, last: Column) -> list[Column]:
    """The terms of a day, in the order of the penalties."""
    u, dow, doy = place(date, first, last), F.weekday(date).cast("double"), F.dayofyear(date).cast("double")
    out = [F.lit(1.0), u]
    out += [F.greatest(u - F.lit(BENDS_UNTIL * k / (BENDS + 1)), F.lit(0.0)) for k in range(1, BENDS + 1)]
    for waves, day, length in ((WEEK_WAVES, dow, 7.0), (YEAR_WAVES, doy, YEAR)):
        for j in range(1, waves + 1):
            angle = day * F.lit(2 * math.pi * j / length)
            out += [F.sin(angle), F.cos(angle)]
    return [*out, promotion.cast("double")]


def _sum_systems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (series, day, sales, terms) to one system per series and task."""
    held: dict[tuple, list] = {}

    def passed_on():
        keys = list(held)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(len(SERIES))]
        columns += [pa.array([held[k][i] for k in keys], pa.int64()) for i in range(3)]
        columns.append(pa.array([held[k][3].ravel() for k in keys], pa.list_(pa.float64())))
        held.clear()
        return pa.RecordBatch.from_arrays(columns, [*SERIES, "n", "first_day", "last_day", "system"])

    for batch in batches:
        keys = batch.select(SERIES).to_pandas()
        codes = keys.groupby(SERIES, sort=False, dropna=False).ngroup().to_numpy()
        day, y = batch.column("day").to_numpy(), batch.column("y").to_numpy()
        x = batch.column("terms").flatten().to_numpy().reshape(-1, SIZE)
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            key = tuple(keys.iloc[rows[0]])
            part = x[rows].T @ np.column_stack((x[rows], y[rows]))
            if key in held:
                known = held[key]
                held[key] = [
                    known[0] + len(rows), min(known[1], day[rows].min()), max(known[2], day[rows].max()), known[3] + part
                ]
            else:
                if len(held) >= HELD_SERIES:
                    yield passed_on()
                held[key] = [len(rows), day[rows].min(), day[rows].max(), part]
    if held:
        yield passed_on()


def systems(learnt: DataFrame, promotion: Column, first: Column, last: Column) -> DataFrame:
    """(series, n, first_day, last_day, system) partial sums: one or more rows per series.

    ``system`` has the Gram matrix of the terms with the products of terms and sales as its
    last column, row by row.  Rows without sales don't count.  Frames of other days of the same
    stretch (``first`` to ``last``) can be united with it.
    """
    rows = learnt.where(F.col("sales").isNotNull()).select(
        *[F.col(c).cast("string").alias(c) for c in SERIES],
        F.unix_date("date").cast("bigint").alias("day"),
        F.col("sales").cast("double").alias("y"),
        F.array(*terms("date", promotion, first, last)).alias("terms"),
    )
    keys = ", ".join(f"{c} string" for c in SERIES)
    return rows.mapInArrow(_sum_systems, f"{keys}, n bigint, first_day bigint, last_day bigint, system array<double>")


def solve(system: np.ndarray, n: int, span: int) -> np.ndarray:
    """Coefficients of one series; parts it is too short for, or never saw vary, are 0."""
    gram, right = system[:, :SIZE].copy(), system[:, SIZE].copy()
    off = np.zeros(SIZE, bool)
    off[WEEKLY] = span <= WEEKLY_AFTER_DAYS
    off[YEARLY] = span <= YEARLY_AFTER_DAYS
    off[-1] = not 0 < system[0, SIZE - 1] < n
    gram[off], gram[:, off], right[off] = 0, 0, 0
    return np.linalg.solve(gram + np.diag(np.array(PENALTIES) * n), right)


def _solve_series(parts: pd.DataFrame) -> pd.DataFrame:
    total = np.sum(np.stack(parts["system"].to_list()), axis=0).reshape(SIZE, SIZE + 1)
    span = int(parts["last_day"].max() - parts["first_day"].min())
    found = solve(total, int(parts["n"].sum()), span)
    return pd.DataFrame({**{c: [parts[c].iloc[0]] for c in SERIES}, "additive": [found]})


def coefficients(parts: DataFrame) -> DataFrame:
    """(series, additive): the solved coefficients of every series of ``systems`` frames."""
    keys = ", ".join(f"{c} string" for c in SERIES)
    return parts.groupBy(*SERIES).applyInPandas(_solve_series, f"{keys}, additive array<double>")


def fit(learnt: DataFrame, promotion: Column) -> DataFrame:
    """(series, additive, first, last) of learnt rows; the stretch is that of all of them."""
    stretch = learnt.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
    found = coefficients(systems(learnt, promotion, stretch["first"], stretch["last"]))
    return found.withColumns({"first": stretch["first"], "last": stretch["last"]})


def additive(promotion: Column, date: str = "date") -> Column:
    """The forecast of a day beside its series' ``additive``, ``first`` and ``last``, clipped at 0 (M5)."""
    parts = [F.get(F.col("additive"), F.lit(i)) * t for i, t in enumerate(terms(date, promotion, F.col("first"), F.col("last")))]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return non_negative(F.coalesce(total, F.lit(0.0)))
