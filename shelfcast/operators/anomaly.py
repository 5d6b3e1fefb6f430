"""Anomaly flags on the daily panel and the data quality score.

``detect`` looks at the previous row and the last rows of a series, so it needs
one row per series and day; give it the daily panel, not raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES, by_date, whole_series
from shelfcast.functions.numeric import half_even, ratio, truthy
from shelfcast.operators.clean import DEFAULT_STORE


@dataclass(frozen=True)
class AnomalyRules:
    """Thresholds of the rules."""

    iqr_multiplier: float = 1.5
    rolling_window: int = 7
    rolling_z_threshold: float = 3.0
    promo_threshold_multiplier: float = 2.0
    weekend_threshold_multiplier: float = 1.2
    price_rules: bool = True
    inventory_rules: bool = True
    drop_mean: float = 10.0
    stock_jump: int = 1000
    price_ratio_high: float = 2.0
    price_ratio_low: float = 0.2


# Weights of the severities in the score, and its bands.
SEVERITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.3, "LOW": 0.05}
CRITICAL_BELOW = 70
WARNING_BELOW = 90
MAX_PAGE_SIZE = 100

FLAG_COLUMNS = ["is_anomaly", "anomaly_score", "anomaly_type", "anomaly_severity", "anomaly_reason"]


def with_default_store(df: DataFrame) -> DataFrame:
    """A1"""
    return df if "store_id" in df.columns else df.withColumn("store_id", F.lit(DEFAULT_STORE))


def demand_bounds(df: DataFrame, rules: AnomalyRules = AnomalyRules()) -> DataFrame:
    """A2: one row per series with the upper IQR fence, for static use on a stream."""
    q = F.percentile("sales", F.array(F.lit(0.25), F.lit(0.75)))
    return (
        df.groupBy(*SERIES)
        .agg(q.alias("q"))
        .select(*SERIES, (F.col("q")[1] + rules.iqr_multiplier * (F.col("q")[1] - F.col("q")[0])).alias("base_upper"))
    )


def context_factor(columns: Sequence[str], rules: AnomalyRules) -> Column:
    """A3: promotions and weekends raise the bound; both together multiply."""
    factor = F.lit(1.0)
    if "is_promotion" in columns:
        factor = factor * F.when(F.col("is_promotion") > 0, rules.promo_threshold_multiplier).otherwise(1.0)
    if "day_of_week" in columns:
        factor = factor * F.when(F.col("day_of_week") >= 5, rules.weekend_threshold_multiplier).otherwise(1.0)
    return factor


def measures(df: DataFrame, rules: AnomalyRules = AnomalyRules()) -> DataFrame:
    """A2-A4 and the previous values the rules compare with, as ``_`` columns."""
    q = F.percentile("sales", F.array(F.lit(0.25), F.lit(0.75))).over(whole_series())
    recent = by_date().rowsBetween(1 - rules.rolling_window, 0)
    added = {
        "_q": q,
        "_mean": F.avg("sales").over(recent),
        "_std": F.coalesce(F.stddev_samp("sales").over(recent), F.lit(1.0)),
    }
    if "current_stock" in df.columns and rules.inventory_rules:
        added["_stock_before"] = F.lag("current_stock").over(by_date())
    if "price" in df.columns and rules.price_rules:
        added["_price_before"] = F.lag("price").over(by_date())
    base = F.col("_q")[1] + rules.iqr_multiplier * (F.col("_q")[1] - F.col("_q")[0])
    return (
        df.withColumns(added)
        .withColumn("_bound", base * context_factor(df.columns, rules))
        .withColumn("_z", F.abs(ratio(F.col("sales") - F.col("_mean"), F.col("_std"))))
        .drop("_q")
    )


def flag(kind: str, severity: str, score: Column | float, reason: Column | str) -> Column:
    return F.struct(
        (F.lit(score) if isinstance(score, float) else score).alias("score"),
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
    )


def rule_flags(columns: Sequence[str], rules: AnomalyRules) -> list[tuple[Column, Column]]:
    """Conditions and flags in the order in which they win.

    A higher severity wins and the earlier rule wins among equals; missing values
    and demand drops end the scan of a row.  Sorting the rules that way turns the
    scan into one CASE.
    """
    sales, bound = F.col("sales"), F.col("_bound")
    spike = truthy(sales > bound) | truthy(F.col("_z") > rules.rolling_z_threshold)
    on_promotion = truthy(F.col("is_promotion") != 0) if "is_promotion" in columns else F.lit(False)
    score = F.least(F.lit(1.0), ratio(sales, bound + F.lit(1e-5)))
    spike_text = F.concat(
        F.lit("Unexplained demand spike ("), sales.cast("double").cast("string"), F.lit(") exceeds context boundaries.")
    )
    missing = truthy(F.col("sales_missing")) if "sales_missing" in columns else F.lit(False)
    ranked: list[tuple[Column, Column]] = [
        (sales.isNull() | missing, flag("MISSING_DATA", "CRITICAL", 1.0, "Missing sales record.")),
        (
            truthy((sales == 0) & (F.col("_mean") > rules.drop_mean)),
            flag("DEMAND_DROP", "MEDIUM", 0.8, "Sudden 0-demand drop against high rolling average."),
        ),
    ]
    if "current_stock" in columns and rules.inventory_rules:
        ranked.append(
            (
                truthy(F.col("current_stock") < 0),
                flag("CRITICAL_DATA_ERROR", "CRITICAL", 1.0, "Impossible negative inventory value."),
            )
        )
    if "price" in columns and rules.price_rules:
        ranked.append(
            (
                truthy(F.col("price") <= 0),
                flag("CRITICAL_DATA_ERROR", "CRITICAL", 1.0, "Impossible negative or zero price value."),
            )
        )
    ranked.append((spike & ~on_promotion & truthy(score > 0.9), flag("DEMAND_SPIKE", "HIGH", half_even(score), spike_text)))
    if "current_stock" in columns and rules.inventory_rules:
        ranked.append(
            (
                truthy(F.col("current_stock") > F.col("_stock_before") + rules.stock_jump),
                flag("INVENTORY_JUMP", "HIGH", 0.8, "Massive unexplained inventory increase."),
            )
        )
    if "price" in columns and rules.price_rules:
        before = F.col("_price_before")
        change = ratio(F.col("price"), before)
        price_text = F.concat(
            F.lit("Massive price variation ("),
            before.cast("double").cast("string"),
            F.lit(" -> "),
            F.col("price").cast("double").cast("string"),
            F.lit(")."),
        )
        ranked.append(
            (
                truthy((before > 0) & ((change > rules.price_ratio_high) | (change < rules.price_ratio_low))),
                flag("PRICE_ANOMALY", "HIGH", 0.9, price_text),
            )
        )
    ranked.append((spike & ~on_promotion, flag("DEMAND_SPIKE", "MEDIUM", half_even(score), spike_text)))
    ranked.append(
        (spike & on_promotion, flag("BUSINESS_EVENT", "LOW", 0.4, "High demand aligns with active promotion context."))
    )
    return ranked


def detect(df: DataFrame, rules: AnomalyRules = AnomalyRules()) -> DataFrame:
    """The panel with ``is_anomaly, anomaly_score, anomaly_type, anomaly_severity, anomaly_reason``."""
    df = with_default_store(df)
    columns = df.columns
    verdict = None
    for condition, finding in rule_flags(columns, rules):
        verdict = F.when(condition, finding) if verdict is None else verdict.when(condition, finding)
    verdict = verdict.otherwise(flag("NORMAL", "NONE", 0.0, ""))
    return (
        measures(df, rules)
        .withColumn("_flag", verdict)
        .select(
            *columns,
            (F.col("_flag.severity") != "NONE").alias("is_anomaly"),
            F.col("_flag.score").alias("anomaly_score"),
            F.col("_flag.type").alias("anomaly_type"),
            F.col("_flag.severity").alias("anomaly_severity"),
            F.col("_flag.reason").alias("anomaly_reason"),
        )
    )


# --- quality score -------------------------------------------------------------------------


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("anomaly_severity") == s).alias(s.lower()) for s in SEVERITY_WEIGHTS]


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_records"), F.count_if("is_anomaly").alias("anomalies"), *_severity_counts()]


def _judged(counted: DataFrame) -> DataFrame:
    weighted = sum((F.col(s.lower()) * w for s, w in SEVERITY_WEIGHTS.items()), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.lit(100.0) - ratio(weighted, F.col("total_records")) * 100.0)
    return (
        counted.withColumn("_score", score)
        .withColumn(
            "status",
            F.when(F.col("total_records") == 0, "ERROR")
            .when(F.col("_score") < CRITICAL_BELOW, "CRITICAL")
            .when((F.col("_score") < WARNING_BELOW) | (F.col("critical") > 0), "WARNING")
            .otherwise("HEALTHY"),
        )
        .withColumn("data_quality_score", F.when(F.col("total_records") == 0, F.lit(0.0)).otherwise(half_even(F.col("_score"))))
        .drop("_score")
    )


def quality(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Q1-Q4: counts, score and status of the whole table, or per ``by`` group.

    The status is taken from the unrounded score.  No rows at all score 0 with
    status ERROR.
    """
    return _judged(flags.groupBy(*by).agg(*_counts()))


def quality_levels(flags: DataFrame) -> DataFrame:
    """Q1-Q4 of every series, every store and the whole table, in one rollup over one scan.

    ``level`` is ``series``, ``store`` or ``all``; keys above the level are null (so are those
    of rows without a store, which the level tells apart).  An empty table gives no rows.
    """
    counted = flags.rollup(*SERIES).agg(*_counts(), F.grouping_id().alias("_level"))
    named = F.when(F.col("_level") == 0, "series").when(F.col("_level") == 1, "store").otherwise("all")
    return _judged(counted.withColumn("level", named).drop("_level"))


def records(flags: DataFrame) -> DataFrame:
    """Q5: the flagged rows as report records."""
    return flags.where("is_anomaly").select(
        *SERIES,
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "anomaly_type",
        F.col("anomaly_severity").alias("severity"),
        F.col("anomaly_score").alias("score"),
        F.col("anomaly_reason").alias("reason"),
        F.coalesce(F.col("sales").cast("double"), F.lit(0.0)).alias("original_value"),
    )


def _chosen(found: DataFrame, store_id: str | None, product_id: str | None) -> DataFrame:
    if store_id is not None:
        found = found.where(F.col("store_id") == store_id)
    if product_id is not None:
        found = found.where(F.col("product_id") == product_id)
    return found


def page_totals(
    found: DataFrame, *, page_size: int = 50, store_id: str | None = None, product_id: str | None = None
) -> DataFrame:
    return _chosen(found, store_id, product_id).agg(
        F.count(F.lit(1)).alias("total"),
        F.ceil(F.count(F.lit(1)) / page_size).cast("bigint").alias("total_pages"),
    )


def page(
    found: DataFrame,
    *,
    page: int = 1,
    page_size: int = 50,
    store_id: str | None = None,
    product_id: str | None = None,
) -> DataFrame:
    """Q6: one page of records in series and date order.

    Records are counted per series; only the series the page falls in are ranked, so a deep
    page gathers no earlier rows.  A series has one record per day at most.
    """
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page starts at 1 and page_size lies between 1 and {MAX_PAGE_SIZE}")
    chosen = _chosen(found, store_id, product_id)
    skip = (page - 1) * page_size
    sizes = chosen.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_size"))
    # Sizes are summed by store first, then within the stores the page touches.
    stores = sizes.groupBy("store_id").agg(F.sum("_size").alias("_all"))
    upto = Window.orderBy("store_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stores = stores.withColumn("_start", F.sum("_all").over(upto) - F.col("_all"))
    stores = stores.where((F.col("_start") < skip + page_size) & (F.col("_start") + F.col("_all") > skip))
    inside = Window.partitionBy("store_id").orderBy("product_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    series = sizes.join(stores, "store_id").withColumn("_before", F.col("_start") + F.sum("_size").over(inside) - F.col("_size"))
    series = series.where((F.col("_before") < skip + page_size) & (F.col("_before") + F.col("_size") > skip))
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy("date"))
    place = F.col("_before") + rank
    # At most as many series as rows on a page.
    return (
        chosen.join(F.broadcast(series.select(*SERIES, "_before")), SERIES)
        .withColumn("_place", place)
        .where((F.col("_place") > skip) & (F.col("_place") <= skip + page_size))
        .orderBy("_place")
        .select(*found.columns)
    )
