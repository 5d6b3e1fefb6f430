"""Drift, forecast error, health and the retraining decision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.keys import SERIES, by_series
from shelfcast.functions.numeric import half_even, ratio
from shelfcast.functions.quantiles import group_quantiles
from shelfcast.functions.skew import skew_join

# Thresholds of drift, error and decisions.
BUCKETS = 10
PSI_LOW = 0.10
PSI_HIGH = 0.25
MAX_WAPE = 0.15
MAX_DEGRADATION = 0.20
MAX_BIAS = 0.10
IMPROVEMENT_MARGIN = 0.02
DRIFTED_SHARE = 0.3
MIN_QUALITY = 70


# --- D1-D3: drift ---------------------------------------------------------------------------


def _entries(features: Sequence[str]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.lit(i).alias("position"), F.col(f).cast("double").alias("value"))
            for i, f in enumerate(features)
        ]
    )


def to_long(rows: DataFrame, features: Sequence[str], by: Sequence[str] = SERIES) -> DataFrame:
    """``(by, side, feature, position, value)``, nulls left out."""
    return rows.select(*by, "side", F.inline(_entries(features))).where(F.col("value").isNotNull())


def _deciles() -> Column:
    return F.array(*[F.lit(i / BUCKETS) for i in range(BUCKETS + 1)])


def _bin(value: Column, edges: Column) -> Column:
    """The bin of ``value`` among ``edges``; null outside them or with fewer than two."""
    last = F.size(edges) - 1
    inside = (last > 0) & (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    # Spelt out edge by edge: a lambda over the array would be interpreted.
    reached = sum((F.coalesce((F.get(edges, F.lit(i)) <= value).cast("int"), F.lit(0)) for i in range(BUCKETS + 1)), F.lit(0))
    return F.when(inside, F.least(reached, last))


def _decile_edges(reference: np.ndarray) -> np.ndarray:
    """The distinct deciles of a sorted column, interpolated as SQL's percentile does."""
    rank = (len(reference) - 1) * (np.arange(BUCKETS + 1) / BUCKETS)
    low, high = np.floor(rank).astype(int), np.ceil(rank).astype(int)
    a, b = reference[low], reference[high]
    return np.unique(np.where(a == b, a, (high - rank) * a + (rank - low) * b))


def _count_bins(reference: np.ndarray, production: np.ndarray) -> list[tuple]:
    """(bin, r, p, bins) of one feature; values outside of all bins are one row with a null bin."""
    edges = _decile_edges(np.sort(reference))
    last = len(edges) - 1
    tally = {}
    for place, values in enumerate((reference, production)):
        inside = (values >= edges[0]) & (values <= edges[-1]) if last else np.zeros(len(values), bool)
        bins, often = np.unique(np.minimum(np.searchsorted(edges, values[inside], "right"), last), return_counts=True)
        for b, n in [*zip(bins.tolist(), often.tolist()), (None, int((~inside).sum()))]:
            if n:
                tally.setdefault(b, [0, 0])[place] += n
    return [(b, r, p, last) for b, (r, p) in tally.items()]


def _bins_of_series(sides: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Counts per bin where a group is a feature of one series.

    Such a group has at most one value per day, so a series' days meet in one place, its
    features side by side as columns, and leave as counts.
    """
    by, features = list(by), list(features)
    rows = sides.select(*by, (F.col("side") == "production").alias("_late"), *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(features)])
    keys = [rows.schema[c] for c in by]
    cells = T.StructType.fromDDL("feature string, position int, bin int, r bigint, p bigint, bins int")

    def count(days: pa.Table) -> pa.Table:
        late = days.column("_late").to_numpy()
        out = []
        for i, f in enumerate(features):
            values = days.column(f"_v{i}")
            known = values.is_valid().to_numpy()
            values = values.to_numpy()
            reference = values[known & ~late]
            if len(reference):
                out += [(f, i, *cell) for cell in _count_bins(reference, values[known & late])]
        own = [pa.array([days.column(c)[0].as_py()] * len(out), days.schema.field(c).type) for c in by]
        made = [pa.array([row[j] for row in out], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))]
        return pa.Table.from_arrays([*own, *made], [*by, *cells.names])

    return rows.groupBy(*by).applyInArrow(count, T.StructType([*keys, *cells.fields]))


def _bins_of_groups(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts per bin for groups of any size.

    Rows are first counted per distinct value; the edges are exact quantiles that
    gather no group, and rows of large groups are spread for the join with them.
    """
    counts = long.groupBy(*group, "value").agg(
        F.count_if(F.col("side") == "reference").alias("r"), F.count_if(F.col("side") == "production").alias("p")
    )
    deciles = [i / BUCKETS for i in range(BUCKETS + 1)]
    edges = group_quantiles(long.where(F.col("side") == "reference"), group, "value", deciles, name="edges")
    edges = edges.withColumn("edges", F.array_sort(F.array_distinct("edges")))
    return (
        skew_join(counts, edges, group, spread=["value"])
        .withColumn("bin", _bin(F.col("value"), F.col("edges")))
        .groupBy(*group, "bin")
        .agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.first(F.size("edges") - 1).alias("bins"))
    )


def stability_index(bins: DataFrame, group: Sequence[str]) -> DataFrame:
    """Population stability index per group from its counts per bin.

    The edges of the bins are the deciles of the reference; values outside them are left
    out, the last bin includes its upper edge, and every bin counts at least 1.  Fewer than
    two distinct edges, or no production values, give 0.
    """
    used = F.col("bin").isNotNull()
    floored = {s: F.when(used, F.greatest(F.col(s), F.lit(1))) for s in ("r", "p")}
    totals = bins.groupBy(*group).agg(
        F.max("bins").alias("bins"),
        F.sum("r").alias("all_r"),
        F.sum("p").alias("all_p"),
        F.count("bin").alias("filled"),
        F.coalesce(F.sum(floored["r"]), F.lit(0)).alias("sum_r"),
        F.coalesce(F.sum(floored["p"]), F.lit(0)).alias("sum_p"),
        F.collect_list(F.when(used, F.struct(floored["r"].alias("r"), floored["p"].alias("p")))).alias("cells"),
    )
    # Empty bins count 1 on both sides; they are added without making rows for them.
    empty = F.col("bins") - F.col("filled")
    sum_r, sum_p = F.col("sum_r") + empty, F.col("sum_p") + empty

    def term(r: Column, p: Column) -> Column:
        return (p / sum_p - r / sum_r) * F.ln((p / sum_p) / (r / sum_r))

    filled = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + term(c["r"], c["p"]))
    index = F.when((F.col("bins") < 1) | (F.col("all_r") == 0) | (F.col("all_p") == 0), F.lit(0.0)).otherwise(
        filled + empty * term(F.lit(1.0), F.lit(1.0))
    )
    return totals.select(*group, index.alias("psi")).select(
        *group,
        "psi",
        F.round("psi", 3).alias("drift_score"),
        F.when(F.col("psi") < PSI_LOW, "LOW").when(F.col("psi") < PSI_HIGH, "MODERATE").otherwise("HIGH").alias("status"),
    )


def feature_drift(
    reference: DataFrame, production: DataFrame, features: Sequence[str], by: Sequence[str] = SERIES
) -> DataFrame:
    """D2 for all groups and features in one job; absent features are skipped."""
    kept = [f for f in features if f in reference.columns and f in production.columns]
    sides = reference.select(*by, *kept, F.lit("reference").alias("side")).unionByName(
        production.select(*by, *kept, F.lit("production").alias("side"))
    )
    return side_drift(sides, kept, by)


def side_drift(sides: DataFrame, features: Sequence[str], by: Sequence[str] = SERIES) -> DataFrame:
    """D2 of one frame whose ``side`` is ``reference`` or ``production``.

    Per series the wide rows move to their series once and stay there.
    """
    group = [*by, "feature", "position"]
    kept = [f for f in features if f in sides.columns]
    if set(SERIES) <= set(by):
        bins = _bins_of_series(by_series(sides), kept, by)
    else:
        bins = _bins_of_groups(to_long(sides, kept, by), group)
    return stability_index(bins, group)


def drift_summary(drift: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """D3: totals and the feature with the largest index (first on ties, "None" if all 0)."""
    drifted = F.count_if(F.col("status") != "LOW")
    # max_by over (index, -position) takes the first of equal features.
    strongest = F.max_by("feature", F.struct(F.col("psi"), -F.col("position")))
    return drift.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_features"),
        drifted.alias("features_with_drift"),
        half_even(drifted / F.count(F.lit(1)) * 100).alias("percentage_drifted"),
        F.when(F.max("psi") > 0, strongest).otherwise("None").alias("highest_drift_feature"),
    )


# --- D4, D5: error ----------------------------------------------------------------------------


def performance(
    rows: DataFrame, reference_wape: DataFrame | None = None, by: Sequence[str] = SERIES
) -> DataFrame:
    """D4, D5 on rows ``(by, actual, forecast)``; WAPE and ``ref_wape`` are fractions."""
    a, f = F.greatest(F.col("actual"), F.lit(0.0)), F.greatest(F.col("forecast"), F.lit(0.0))
    e = a - f
    total = F.sum(a)
    out = rows.groupBy(*by).agg(
        F.avg(e).alias("bias"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(total > 0, F.sum(F.abs(e)) / total).otherwise(F.avg(F.abs(e))).alias("wape"),
        F.avg(e).alias("residual_mean"),
        F.stddev_pop(e).alias("residual_std"),
        F.avg(a).alias("_mean"),
    )
    if reference_wape is None:
        out = out.withColumn("ref_wape", F.lit(None).cast("double"))
    else:
        out = out.join(reference_wape.select(*by, "ref_wape"), list(by), "left")
    degradation = F.when(F.col("ref_wape") > 0, ratio(F.col("wape") - F.col("ref_wape"), F.col("ref_wape"))).otherwise(0.0)
    out = out.withColumn("degradation", F.coalesce(degradation, F.lit(0.0)))
    status = (
        F.when(F.col("degradation") > MAX_DEGRADATION, "PERFORMANCE_DEGRADATION")
        .when(F.col("wape") > MAX_WAPE, "HIGH_ERROR")
        .when(F.abs("bias") / (F.col("_mean") + F.lit(1e-5)) > MAX_BIAS, "HIGH_BIAS")
        .otherwise("HEALTHY")
    )
    figures = ("wape", "mae", "rmse", "bias", "residual_mean", "residual_std", "degradation")
    return out.withColumn("status", status).select(*by, *[half_even(F.col(c), 4).alias(c) for c in figures], "status")


# --- D6-D10: health and decisions ---------------------------------------------------------------


def decision(quality: Column, status: Column, total_features: Column, drifted_features: Column) -> Column:
    """D8"""
    degraded = status.isin("PERFORMANCE_DEGRADATION", "HIGH_ERROR")
    drifted = (total_features > 0) & (drifted_features > total_features * DRIFTED_SHARE)
    return (
        F.when(quality < MIN_QUALITY, "INVESTIGATE")
        .when(degraded & drifted, "URGENT_RETRAIN")
        .when(degraded, "RETRAIN")
        .when((status == "HIGH_BIAS") | drifted, "MONITOR")
        .otherwise("NO_ACTION")
    )


def promote(reference_wape: Column, candidate_wape: Column) -> Column:
    """Nothing to compare with, or at least two percent better."""
    gain = ratio(reference_wape - candidate_wape, reference_wape)
    return F.when(F.coalesce(reference_wape, F.lit(0.0)) == 0, True).otherwise(F.coalesce(gain >= IMPROVEMENT_MARGIN, F.lit(False)))


def health(scored: DataFrame, models: DataFrame, sides: DataFrame, features: Sequence[str], quality: DataFrame) -> DataFrame:
    """One health row per series with actuals.

    ``scored``: ``(series, actual, forecast)``; ``models``: production models with
    ``version_id, wape`` (percent) and ``registered_at``; ``sides``: the days to compare, as
    ``side_drift`` takes them; ``quality``: one row with ``data_quality_score``.  A series without a model is reported as missing.
    """
    reference_wape = models.select(*SERIES, (F.col("wape") / 100).alias("ref_wape"))
    error = performance(scored, reference_wape)
    drift = drift_summary(side_drift(sides, features))
    joined = (
        error.join(drift, SERIES, "left")
        .join(models.select(*SERIES, "version_id", "registered_at"), SERIES, "left")
        .withColumn("data_quality_score", quality.select("data_quality_score").scalar())
    )
    modelled = F.col("version_id").isNotNull()

    def only_modelled(column: str, otherwise) -> Column:
        return F.when(modelled, F.coalesce(F.col(column), F.lit(otherwise))).otherwise(F.lit(otherwise))

    joined = joined.withColumns(
        {
            "total_features": only_modelled("total_features", 0),
            "features_with_drift": only_modelled("features_with_drift", 0),
            "percentage_drifted": only_modelled("percentage_drifted", 0.0),
            "highest_drift_feature": only_modelled("highest_drift_feature", "None"),
        }
    )
    choice = decision(
        F.col("data_quality_score"), F.col("status"), F.col("total_features"), F.col("features_with_drift")
    )
    return joined.select(
        *SERIES,
        F.coalesce("version_id", F.lit("None")).alias("production_model"),
        F.when(~modelled, "ARCHIVED/MISSING")
        .when(F.col("status") == "HEALTHY", "HEALTHY")
        .otherwise("DEGRADED")
        .alias("model_status"),
        "data_quality_score",
        F.struct("total_features", "features_with_drift", "percentage_drifted", "highest_drift_feature").alias("drift"),
        F.struct("wape", "mae", "rmse", "bias", "residual_mean", "residual_std", "status", "degradation").alias("performance"),
        F.when(~modelled, "URGENT_RETRAIN").otherwise(choice).alias("retraining_decision"),
        F.when(modelled, 0).otherwise(1).alias("problem_products"),
        F.coalesce(F.col("registered_at").cast("string"), F.lit("Never")).alias("last_training_date"),
    )


def retrain_gate(asked: DataFrame, reports: DataFrame) -> DataFrame:
    """Requests against the reports of their series; one result per request."""
    verdicts = reports.select(*SERIES, "retraining_decision")
    decided = skew_join(asked, verdicts, SERIES, spread=asked.columns, how="left")
    idle = F.col("retraining_decision").isin("NO_ACTION", "MONITOR")
    return decided.select(
        *asked.columns,
        F.when(F.col("retraining_decision").isNull(), "NOT_FOUND").when(idle, "REJECTED").otherwise("ACCEPTED").alias("status"),
        F.when(F.col("retraining_decision").isNull(), "Cannot decide retraining, no report exists.")
        .when(idle, F.concat(F.lit("Decision was "), F.col("retraining_decision"), F.lit(". System is healthy.")))
        .otherwise(F.concat(F.lit("Retraining triggered for "), F.col("product_id"), F.lit(".")))
        .alias("message"),
    )
