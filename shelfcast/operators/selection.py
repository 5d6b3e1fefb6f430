"""Forecast metrics, choice of a champion per series and its version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES
from shelfcast.functions.numeric import half_even, ratio
from shelfcast.operators.forecast import CANDIDATES, NAIVE, candidate_columns

# Reliability bands (WAPE in percent) and the gain a challenger needs.
RELIABILITY = [(10, "Excellent"), (20, "Good"), (35, "Moderate")]
LOWEST_RELIABILITY = "Low"
MIN_GAIN_PERCENT = 2.0
ZERO_SALES = 1e-6


def metric_aggregates(y: str, yhat: str, prefix: str = "") -> list[Column]:
    """M7-M9 as aggregates: MAE, RMSE, MAPE % over non-zero actuals, WAPE %."""
    actual, error = F.col(y), F.col(y) - F.col(yhat)
    total = F.sum(actual)
    nonzero = F.avg(F.when(actual != 0, F.abs(ratio(error, actual)))) * 100
    return [
        F.coalesce(F.avg(F.abs(error)), F.lit(0.0)).alias(f"{prefix}mae"),
        F.coalesce(F.sqrt(F.avg(error * error)), F.lit(0.0)).alias(f"{prefix}rmse"),
        F.coalesce(nonzero, F.lit(0.0)).alias(f"{prefix}mape"),
        (F.coalesce(F.sum(F.abs(error)) / F.when(total == 0, F.lit(ZERO_SALES)).otherwise(total), F.lit(0.0)) * 100).alias(
            f"{prefix}wape"
        ),
        F.count(actual).alias(f"{prefix}n"),
    ]


def reliability(wape: Column, n: Column) -> Column:
    """The band of an unrounded WAPE; nothing scored is Low."""
    band = F.when(n == 0, LOWEST_RELIABILITY)
    for below, name in RELIABILITY:
        band = band.when(wape < below, name)
    return band.otherwise(LOWEST_RELIABILITY)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("reliability", reliability(F.col("wape"), F.col("n"))).withColumns(
        {m: half_even(F.col(m)) for m in ("mae", "rmse", "mape", "wape")}
    )


def score(long: DataFrame, by: Sequence[str] = (*SERIES, "model_type")) -> DataFrame:
    """M7-M11 on a long table ``(…, y, yhat)``."""
    return _rounded(long.groupBy(*by).agg(*metric_aggregates("y", "yhat")))


def score_candidates(rows: DataFrame) -> DataFrame:
    """The comparison table from candidate columns.

    All candidates are aggregated in one pass over the wide rows and only the one
    row per series is turned long.
    """
    models = candidate_columns(rows)
    aggs = [a for i, m in enumerate(models) for a in metric_aggregates("sales", m, f"c{i}_")]
    wide = rows.groupBy(*SERIES).agg(F.bool_or("naive_only").alias("_gated"), *aggs)
    entries = [
        F.struct(
            F.lit(m).alias("model_type"),
            *[F.col(f"c{i}_{x}").alias(x) for x in ("mae", "rmse", "mape", "wape", "n")],
        )
        for i, m in enumerate(models)
    ]
    long = wide.select(*SERIES, "_gated", F.inline(F.array(*entries)))
    return _rounded(long.where(~F.col("_gated") | (F.col("model_type") == NAIVE)).drop("_gated"))


def _candidate_order() -> Column:
    order = F.lit(len(CANDIDATES))
    for i, m in reversed(list(enumerate(CANDIDATES))):
        order = F.when(F.col("model_type") == m, i).otherwise(order)
    return order


def best(scores: DataFrame) -> DataFrame:
    """Lowest WAPE, then MAE, then candidate order.  A series has few scores."""
    first = Window.partitionBy(*SERIES).orderBy("wape", "mae", _candidate_order(), "model_type")
    return scores.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def select_champions(scores: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The model to serve for each series, its version and id.

    ``current`` holds ``(series, model_type, version)``.  The current champion stays
    unless the best candidate lowers its newly measured WAPE by at least two
    percent.  The version counts up while the type stays the same.
    """
    metrics = ["mae", "rmse", "mape", "wape", "reliability"]
    entry = F.struct("model_type", *metrics)
    order = Window.partitionBy(*SERIES).orderBy("wape", "mae", _candidate_order(), "model_type")
    ranked = scores.withColumn("_r", F.row_number().over(order))
    if current is None:
        ranked = ranked.withColumns({"champion_type": F.lit(None).cast("string"), "champion_version": F.lit(None).cast("bigint")})
    else:
        held = current.select(
            *SERIES, F.col("model_type").alias("champion_type"), F.col("version").cast("bigint").alias("champion_version")
        )
        ranked = ranked.join(held, SERIES, "left")
    per_series = ranked.groupBy(*SERIES).agg(
        F.max(F.when(F.col("_r") == 1, entry)).alias("_best"),
        F.max(F.when(F.col("model_type") == F.col("champion_type"), entry)).alias("_held"),
        F.max("champion_type").alias("champion_type"),
        F.max("champion_version").alias("champion_version"),
        F.array_sort(F.collect_list(F.struct("_r", "model_type", *metrics))).alias("_all"),
    )
    gain = ratio(F.col("_held.wape") - F.col("_best.wape"), F.col("_held.wape")) * 100
    keep = F.coalesce(
        (F.col("_held.model_type") != F.col("_best.model_type")) & (F.col("_held.wape") > 0) & (gain < MIN_GAIN_PERCENT),
        F.lit(False),
    )
    chosen = per_series.withColumn("_pick", F.when(keep, F.col("_held")).otherwise(F.col("_best")))
    version = F.when(F.col("_pick.model_type") == F.col("champion_type"), F.col("champion_version") + 1).otherwise(1)
    return chosen.withColumn("version", version.cast("bigint")).select(
        *SERIES,
        F.concat_ws("_", *SERIES, F.col("_pick.model_type"), F.concat(F.lit("v"), F.col("version").cast("string"))).alias(
            "model_id"
        ),
        F.col("_pick.model_type").alias("model_type"),
        *[F.col(f"_pick.{m}").alias(m) for m in metrics],
        "version",
        F.lit("production").alias("status"),
        keep.alias("kept_champion"),
        F.transform("_all", lambda e: F.struct(*[e[x].alias(x) for x in ("model_type", *metrics)])).alias("all_results"),
    )
