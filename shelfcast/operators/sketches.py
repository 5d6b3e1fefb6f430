"""Drift between any two periods from stored sketches instead of rows.

Every (series, feature, month) keeps a KLL sketch of its values.  Sketches merge: months into
periods, series into stores, products or all, so any two periods at any level compare without reading
a day again, and a new month only adds its own sketches.  A sketch of up to about ``SIZE`` values holds
them all, and counts of fewer than ``GRID`` values read from it are exact; beyond that ranks err by ``rank_error()`` of the
number of values, whichever way sketches were merged.  ``monitor.feature_drift`` stays the exact way.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES
from shelfcast.operators import monitor

SIZE = 1024
"""The sketches' size parameter: larger ones err less and hold more."""


GRID = 1000
"""Even ranks at which a sketch is read to place the other period's edges in it."""


def rank_error(size: int = SIZE) -> float:
    """The share of values by which a rank may be off, with 99 % confidence: a published fit for KLL
    sketches, and half a step of the grid."""
    return 2.446 / size**0.9433 + 0.5 / GRID


def monthly(rows: DataFrame, features: Sequence[str], by: Sequence[str] = SERIES, *, size: int = SIZE) -> DataFrame:
    """``(by, month, feature, position, n, sketch)`` of the rows' non-null values; no row for a feature without any.

    One aggregate of the wide rows with map-side combine; only its few rows turn long.
    Absent features are skipped, NaN counts as missing.
    """
    kept = [f for f in features if f in rows.columns]
    values = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in kept}
    month = F.trunc("date", "month").alias("month")
    wide = rows.groupBy(*by, month).agg(
        *[F.kll_sketch_agg_double(v, size).alias(f"_s{i}") for i, v in enumerate(values.values())],
        *[F.count(v).alias(f"_n{i}") for i, v in enumerate(values.values())],
    )
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.lit(i).alias("position"), F.col(f"_n{i}").alias("n"), F.col(f"_s{i}").alias("sketch"))
            for i, f in enumerate(kept)
        ]
    )
    return wide.select(*by, "month", F.inline(cells)).where(F.col("n") > 0)


def merged(sketches: DataFrame, by: Sequence[str] = SERIES, *, first: date | None = None, last: date | None = None, size: int = SIZE) -> DataFrame:
    """``(by, feature, position, n, sketch)`` of the months from that of ``first`` to that of ``last``.

    ``by`` may name fewer columns than the sketches were made for.
    """
    if first is not None:
        sketches = sketches.where(F.col("month") >= F.lit(first.replace(day=1)))
    if last is not None:
        sketches = sketches.where(F.col("month") <= F.lit(last))
    return sketches.groupBy(*by, "feature", "position").agg(
        F.kll_merge_agg_double("sketch", size).alias("sketch"), F.sum("n").alias("n")
    )


def quantiles(sketch: Column | str, probs: Sequence[float]) -> Column:
    """Values of the sketch at each share, without interpolation."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(p)) for p in probs]))


def _cumulated(sketch: str, n: str, edges: Column) -> Column:
    """How many values lie below each edge; at the last one, how many up to it."""
    # Ranks of given values can only be had for literals, so the edges are placed among values at even ranks.
    grid = quantiles(sketch, [(j - 0.5) / GRID for j in range(1, GRID + 1)])
    last = F.size(edges) - 1

    def placed(g: Column) -> Column:
        share = F.transform(
            edges, lambda e, i: F.size(F.filter(g, lambda v: F.when(i < last, v < e).otherwise(v <= e))) / F.lit(float(GRID))
        )
        return F.transform(share, lambda s: F.round(s * F.col(n)).cast("bigint"))

    # One-element arrays name a value, so that it is computed once.
    return F.transform(F.array(grid), placed)[0]


def binned(reference: DataFrame, production: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Counts of two merged periods per bin between the reference's deciles, as ``stability_index`` takes them.

    Values outside the bins are one more row with a null bin.
    """
    group = [*by, "feature", "position"]
    deciles = [i / monitor.BUCKETS for i in range(monitor.BUCKETS + 1)]
    both = reference.select(*group, F.col("sketch").alias("_r"), F.col("n").alias("_rn")).join(
        production.select(*group, F.col("sketch").alias("_p"), F.col("n").alias("_pn")), group, "left"
    )
    both = both.withColumn("_edges", F.array_sort(F.array_distinct(quantiles("_r", deciles))))
    edges = F.col("_edges")

    def counts(sketch: str, n: str) -> Column:
        """Per bin; the last one includes its upper edge."""

        def steps(u: Column) -> Column:
            return F.zip_with(F.slice(u, F.lit(2), F.size(u) - 1), F.slice(u, F.lit(1), F.size(u) - 1), lambda b, a: b - a)

        return F.when(F.col(n).isNotNull(), F.transform(F.array(_cumulated(sketch, n, edges)), steps)[0])

    both = both.withColumn("_rc", counts("_r", "_rn")).withColumn("_pc", counts("_p", "_pn"))
    zero = F.lit(0).cast("bigint")
    cells = F.transform(
        F.sequence(F.lit(0), F.size(edges) - 1),
        lambda i: F.struct(
            F.when(i > 0, i).alias("bin"),
            F.when(i > 0, F.coalesce(F.get("_rc", i - 1), zero)).otherwise(zero).alias("r"),
            F.when(i > 0, F.coalesce(F.get("_pc", i - 1), zero))
            .otherwise(F.coalesce(F.col("_pn"), zero) - F.aggregate(F.coalesce("_pc", F.array(zero)), zero, lambda s, c: s + c))
            .alias("p"),
        ),
    )
    return both.select(*group, (F.size(edges) - 1).alias("bins"), F.col("_rn").alias("n_reference"), F.inline(cells))


def drift(sketches: DataFrame, reference: tuple[date, date], production: tuple[date, date], by: Sequence[str] = SERIES, *, size: int = SIZE) -> DataFrame:
    """D1, D2 between the months of two periods (first and last day of each): ``(by, feature, position, psi, drift_score, status)``.

    Groups without a value in the reference period give no row, ones without any in the production period 0.
    A reference that lies in one value has no bins and gives 0 as well.
    """
    before = merged(sketches, by, first=reference[0], last=reference[1], size=size)
    after = merged(sketches, by, first=production[0], last=production[1], size=size)
    cells = binned(before, after, by)
    # All references have values, also where one edge leaves them outside of every bin.
    cells = cells.withColumn("r", F.when(F.col("bin").isNull(), F.col("n_reference")).otherwise(F.col("r")))
    return monitor.stability_index(cells, [*by, "feature", "position"])
