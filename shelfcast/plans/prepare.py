"""Raw sales to the dense panel, with the daily table written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.clean import daily, densify, fill_from_product, flag_outliers
from shelfcast.session import materialise


def _written(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The written daily aggregate, and the same with missing values filled."""
    days = materialise(daily(df, **options), "daily")
    lacks = days.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in ("price", "promotion")]).first()
    filled = days
    for column in ("price", "promotion"):
        if lacks[column]:
            filled = fill_from_product(filled, column)
    return days, filled


def daily_table(df: DataFrame, **options) -> DataFrame:
    """Cleaned daily rows (P1-P8) on top of a written daily aggregate.

    The aggregate is the only step that reads the raw rows.  The median fill is
    planned only when a value is in fact missing.
    """
    return flag_outliers(_written(df, **options)[1])


def sales_panel(df: DataFrame, *, scope: str = "observed", **options) -> DataFrame:
    """Raw rows to the gap-free daily panel."""
    days, filled = _written(df, **options)
    return densify(filled, scope=scope, extent=days, flag=True)


def prepared(df: DataFrame, *, scope: str = "observed", **options) -> tuple[DataFrame, DataFrame]:
    """The daily rows that exist, for the anomaly scan, and the panel, from one reading of the raw rows.

    A day whose sales are all missing is 0 in the panel, but null for the scan: it counts
    neither in the fence nor in the rolling measures, and is flagged as missing.
    """
    days, filled = _written(df, keep_missing=True, **options)
    panel = densify(filled.drop("sales_missing"), scope=scope, extent=days, flag=True)
    known = F.when(~F.col("sales_missing"), F.col("sales"))
    return flag_outliers(filled).withColumn("sales", known), panel
