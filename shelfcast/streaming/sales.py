"""Daily totals and rule flags on a stream of sale events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES
from shelfcast.functions.numeric import half_even, ratio, truthy
from shelfcast.operators.anomaly import AnomalyRules, context_factor, flag

DELAY = "2 days"


def daily_totals(
    events: DataFrame, keys: Sequence[str] = SERIES, *, value: str = "sales", delay: str = DELAY
) -> DataFrame:
    """Events and units per day and key; events later than ``delay`` are dropped.

    Totals combine before the shuffle, so a busy key sends one row per task.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), *keys)
        .agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("sales"))
        .select(F.col("window.start").cast("date").alias("date"), *keys, "events", "sales")
    )


def rule_flags(events: DataFrame, bounds: DataFrame, rules: AnomalyRules = AnomalyRules()) -> DataFrame:
    """The rules that need no history, with each series' bound from a static table.

    ``bounds`` holds ``(series, base_upper)``; a series without one is only checked
    for impossible values.
    """
    bounded = events.join(bounds, SERIES, "left").withColumn("_bound", F.col("base_upper") * context_factor(events.columns, rules))
    score = F.least(F.lit(1.0), ratio(F.col("sales"), F.col("_bound") + F.lit(1e-5)))
    spike = truthy(F.col("sales") > F.col("_bound"))
    on_promotion = truthy(F.col("is_promotion") != 0) if "is_promotion" in events.columns else F.lit(False)
    error = flag("CRITICAL_DATA_ERROR", "CRITICAL", 1.0, "Impossible value.")
    found = F.when(F.col("sales").isNull(), flag("MISSING_DATA", "CRITICAL", 1.0, "Missing sales record."))
    if "current_stock" in events.columns:
        found = found.when(truthy(F.col("current_stock") < 0), error)
    if "price" in events.columns:
        found = found.when(truthy(F.col("price") <= 0), error)
    found = (
        found.when(spike & on_promotion, flag("BUSINESS_EVENT", "LOW", 0.4, "High demand on a promotion."))
        .when(spike & (score > 0.9), flag("DEMAND_SPIKE", "HIGH", half_even(score), "Unexplained demand spike."))
        .when(spike, flag("DEMAND_SPIKE", "MEDIUM", half_even(score), "Unexplained demand spike."))
    )
    return (
        bounded.withColumn("_f", found)
        .where(F.col("_f").isNotNull())
        .select(
            *events.columns,
            F.col("_f.type").alias("anomaly_type"),
            F.col("_f.severity").alias("anomaly_severity"),
            F.col("_f.score").alias("anomaly_score"),
        )
    )
