"""Exact grouped quantiles (linear interpolation) for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialise

# Rank error of the sketch is rows / _ACCURACY; the bracket is twice as wide.
_ACCURACY = 10_000


def group_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    name: str = "quantiles",
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per group with an array of exact quantiles of the non-null values.

    One way for groups of all sizes.  Values are counted per ``(group, value)`` with map-side
    combine, so a group of any number of rows spreads over the cluster.  A sketch gives a
    bracket around every wanted rank, widened to the next value on either side; counts below
    it are summed and only the values inside are ranked.  A bracket that misses its rank
    raises, so what comes out is exact and the same for any partitioning.  ``counts`` takes
    the counted values (``keys``, ``_v``, ``_n``) where the caller has them.
    """
    keys = list(keys)
    present = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if counts is None:
        counts = present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    margin = 2.0 / _ACCURACY
    edges = [max(p - margin, 0.0) for p in probs] + [min(p + margin, 1.0) for p in probs]
    sketch = present.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(_ACCURACY)).alias("_edges"),
        F.count(F.lit(1)).alias("_total"),
    )
    # A row per group, written: the brackets are used twice.
    return _ranked(counts, materialise(sketch, "sketch"), keys, probs, name)


def _ranked(counts: DataFrame, sketch: DataFrame, keys: Sequence[str], probs: Sequence[float], name: str) -> DataFrame:
    """Quantiles from counted values and, per group, ``_edges`` (lower, then upper) and ``_total``."""
    k = len(probs)
    brackets = sketch.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_i"),
                        (F.lit(float(p)) * (F.col("_total") - 1)).alias("_rank"),
                        F.col("_edges")[i].alias("_from"),
                        F.col("_edges")[k + i].alias("_to"),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        ),
    )
    group = [*keys, "_i"]
    placed = counts.join(brackets, keys)
    under, over = F.col("_v") < F.col("_from"), F.col("_v") > F.col("_to")
    around = placed.groupBy(*group).agg(
        F.coalesce(F.sum(F.when(under, F.col("_n"))), F.lit(0)).alias("_below"),
        F.max(F.when(under, F.col("_v"))).alias("_prev"),
        F.max_by(F.when(under, F.col("_n")), F.when(under, F.col("_v"))).alias("_prev_n"),
        F.min(F.when(over, F.col("_v"))).alias("_next"),
    )
    inside = placed.join(around, group).where(
        (F.col("_v") >= F.coalesce("_prev", "_from")) & (F.col("_v") <= F.coalesce("_next", "_to"))
    )
    before = F.col("_below") - F.coalesce("_prev_n", F.lit(0))
    upto = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("_before", before).withColumn("_cum", F.col("_before") + F.sum("_n").over(upto))
    lower, upper = F.floor("_rank"), F.ceil("_rank")
    picked = ranked.groupBy(*group, "_rank").agg(
        F.min(F.when(F.col("_cum") > lower, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > upper, F.col("_v"))).alias("_b"),
        F.min("_before").alias("_before"),
    )
    found = (F.col("_before") <= lower) & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    value = F.when(lower == upper, F.col("_a")).otherwise((upper - F.col("_rank")) * F.col("_a") + (F.col("_rank") - lower) * F.col("_b"))
    picked = picked.withColumn("_q", F.when(found, value).otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double")))
    return picked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias(name)
    )
