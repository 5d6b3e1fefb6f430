"""Features of the daily panel and the chronological split.

All window features share one partitioning (the series) and one order (the day),
so the whole set costs one shuffle, or none when the panel comes from ``densify``.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from shelfcast.functions.keys import SERIES, by_date
from shelfcast.functions.numeric import ratio

# Lags, windows, split shares and columns that are no features.
LAGS = [1, 7, 14, 28]
MEAN_WINDOWS = [7, 14, 28]
SPREAD_WINDOWS = [7, 28]
TRAIN_SHARE = 0.7
VALIDATION_SHARE = 0.15
NOT_FEATURES = [
    "date",
    "sales",
    "is_outlier",
    "safety_stock",
    "lead_time_days",
    "price",
    "store_id",
    "product_id",
    "category",
]


def calendar_features(df: DataFrame) -> DataFrame:
    """calendar parts (Monday = 0) and their sine and cosine."""
    df = df.withColumns(
        {
            "day_of_week": F.weekday("date"),
            "day_of_month": F.dayofmonth("date"),
            "week_of_year": F.weekofyear("date"),
            "month": F.month("date"),
            "quarter": F.quarter("date"),
            "day_of_year": F.dayofyear("date"),
            "is_weekend": (F.weekday("date") >= 5).cast("int"),
        }
    )
    week, year = F.col("day_of_week") * F.lit(2 * pi) / 7, F.col("month") * F.lit(2 * pi) / 12
    return df.withColumns(
        {"sin_day_of_week": F.sin(week), "cos_day_of_week": F.cos(week), "sin_month": F.sin(year), "cos_month": F.cos(year)}
    )


def lag_features(df: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """earlier sales and whether that much history exists."""
    lagged = df.withColumns({f"lag_{n}": F.lag("sales", n).over(by_date()) for n in lags})
    return lagged.withColumns({f"has_lag_{n}": F.col(f"lag_{n}").isNotNull().cast("int") for n in lags})


def rolling_features(df: DataFrame) -> DataFrame:
    """statistics of the n days before the row; the row itself is left out."""
    added = {}
    for n in MEAN_WINDOWS:
        past = by_date().rowsBetween(-n, -1)
        added[f"rolling_mean_{n}"] = F.avg("sales").over(past)
        if n in SPREAD_WINDOWS:
            added[f"rolling_std_{n}"] = F.stddev_samp("sales").over(past)
            added[f"rolling_min_{n}"] = F.min("sales").over(past)
            added[f"rolling_max_{n}"] = F.max("sales").over(past)
    return df.withColumns(added)


def trend_features(df: DataFrame) -> DataFrame:
    """short mean against long mean."""
    if not {"rolling_mean_7", "rolling_mean_28"} <= set(df.columns):
        return df
    short, long = F.col("rolling_mean_7"), F.col("rolling_mean_28")
    return df.withColumn("trend_ratio", F.when(long == 0, F.lit(0.0)).otherwise(ratio(short, long)))


def sparse_history(days: DataFrame, *, first: Column | None = None) -> DataFrame:
    """F3-F7 of the daily rows that exist, without making the empty days between them.

    Frames reach over day numbers instead of rows: an absent day is a day without sales, so it adds
    nothing to sums and counts as a zero in means, spreads, minima and maxima.  Days before a
    series' first row (or before ``first``, where all series begin) are no history.  One row per
    series and day; null sales count as 0.
    """
    names = days.columns
    sales = F.coalesce(F.col("sales").cast("double"), F.lit(0.0))
    rows = days.withColumn("_day", F.unix_date("date")).withColumn("_sales", sales)
    series = Window.partitionBy(*SERIES)
    begin = F.min("_day").over(series) if first is None else F.unix_date(first)
    rows = rows.withColumn("_behind", F.col("_day") - begin)
    order = series.orderBy("_day")
    behind, added = F.col("_behind"), {}
    for n in LAGS:
        then = F.coalesce(F.sum("_sales").over(order.rangeBetween(-n, -n)), F.lit(0.0))
        added[f"lag_{n}"] = F.when(behind >= n, then)
    for n in MEAN_WINDOWS:
        past = order.rangeBetween(-n, -1)
        many = F.least(behind, F.lit(n))
        there = F.count("_sales").over(past)
        mean = F.when(many > 0, F.coalesce(F.sum("_sales").over(past), F.lit(0.0)) / many)
        added[f"rolling_mean_{n}"] = mean
        if n in SPREAD_WINDOWS:
            # Squares around the mean: those of the days there are, and of the absent ones.
            own = F.coalesce(F.var_pop("_sales").over(past), F.lit(0.0))
            shift = F.coalesce(F.avg("_sales").over(past), F.lit(0.0)) - mean
            squares = there * (own + shift * shift) + (many - there) * mean * mean
            added[f"rolling_std_{n}"] = F.when(many > 1, F.sqrt(squares / (many - 1)))
            for name, extreme, pick in (("min", F.min, F.least), ("max", F.max, F.greatest)):
                value = extreme("_sales").over(past)
                added[f"rolling_{name}_{n}"] = F.when(many > 0, F.when(there == many, value).otherwise(pick(value, F.lit(0.0))))
    rows = rows.withColumns(added).withColumns({f"has_lag_{n}": F.col(f"lag_{n}").isNotNull().cast("int") for n in LAGS})
    return trend_features(rows.select(*names, *added, *[f"has_lag_{n}" for n in LAGS]))


def promotion_features(df: DataFrame) -> DataFrame:
    """F8"""
    if "promotion" not in df.columns:
        return df
    return df.withColumn("is_promotion", F.coalesce((F.col("promotion") > 0).cast("int"), F.lit(0)))


def price_features(df: DataFrame) -> DataFrame:
    """previous price, change and relative change."""
    if "price" not in df.columns:
        return df
    df = df.withColumn("previous_price", F.lag("price", 1).over(by_date()))
    df = df.withColumn("price_change", F.col("price") - F.col("previous_price"))
    change = F.when(F.col("previous_price") == 0, F.lit(0.0)).otherwise(ratio(F.col("price_change"), F.col("previous_price")))
    return df.withColumn("price_change_pct", change)


def engineer(df: DataFrame) -> DataFrame:
    """every feature; missing optional columns are skipped."""
    for step in (
        calendar_features,
        lag_features,
        rolling_features,
        trend_features,
        promotion_features,
        price_features,
    ):
        df = df.transform(step)
    return df


def one_hot(df: DataFrame, values: dict[str, Sequence[str]]) -> DataFrame:
    """a boolean column per listed value.

    The domains are given by the caller: reading them from the data would make
    the schema depend on it, and a store or product list can be long.
    """
    return df.withColumns({f"{c}_{v}": F.coalesce(F.col(c) == v, F.lit(False)) for c, vs in values.items() for v in vs})


def numeric_features(df: DataFrame) -> list[str]:
    """numeric columns a model may see (booleans are not numeric)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in NOT_FEATURES]


def feature_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """how many features of each family, and missing and infinite values."""
    new = [c for c in after.columns if c not in before.columns]
    calendar = ("day_of_", "week_of_year", "month", "quarter", "is_weekend", "sin_", "cos_")
    families = {
        "input_columns": len(before.columns),
        "generated": len(new),
        "lag": sum(c.startswith("lag_") for c in new),
        "history_flags": sum(c.startswith("has_lag_") for c in new),
        "rolling": sum(c.startswith("rolling_") for c in new),
        "calendar": sum(c.startswith(calendar) for c in new),
        "trend": sum(c.startswith("trend_") for c in new),
        "promotion": sum("promotion" in c for c in new),
        "price": sum("price" in c for c in new),
    }
    missing, infinite = F.lit(0), F.lit(0)
    for field in after.schema.fields:
        missing = missing + F.col(f"`{field.name}`").isNull().cast("int")
        if field.dataType.typeName() in ("double", "float"):
            infinite = infinite + F.coalesce(F.abs(F.col(f"`{field.name}`")) == F.lit(float("inf")), F.lit(False)).cast("int")
    return after.select(missing.cast("bigint").alias("m"), infinite.cast("bigint").alias("i")).agg(
        *[F.lit(n).cast("bigint").alias(name) for name, n in families.items()],
        F.coalesce(F.sum("m"), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("infinite_values"),
    )


def split_bounds(dates: DataFrame, train: float = TRAIN_SHARE, validation: float = VALIDATION_SHARE) -> DataFrame:
    """One row: the first validation date and the first test date.

    The distinct dates are one row per calendar day (a century is 36 525 rows), so
    one task orders them.
    """
    numbered = (
        dates.select("date")
        .distinct()
        .withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    )

    def first_from(share: float) -> Column:
        return F.min(F.when(F.col("_i") >= F.floor(F.col("_n") * F.lit(share)), F.col("date")))

    return numbered.agg(first_from(train).alias("validation"), first_from(train + validation).alias("test"))


def chronological_split(
    df: DataFrame, *, dates: DataFrame | None = None, train: float = TRAIN_SHARE, validation: float = VALIDATION_SHARE
) -> DataFrame:
    """adds ``split`` by the position of the row's date among all dates.

    The parts follow each other in time, so two dates decide; as scalars they also
    reach the scan when a part is selected.  ``dates`` lets the caller give a
    cheaper source of the same dates than the frame itself.
    """
    bounds = split_bounds(df if dates is None else dates, train, validation)
    start = bounds.select(F.struct("validation", "test")).scalar()
    label = F.when(F.col("date") < start["validation"], "train").when(F.col("date") < start["test"], "validation")
    return df.withColumn("split", label.otherwise("test"))
