"""Figures and slices for dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.sources.sales import recent_slice


def recent_totals(panel: DataFrame, days: int = 60) -> DataFrame:
    """B1: units sold and products present in the newest days."""
    return recent_slice(panel, days).agg(
        F.coalesce(F.sum("sales"), F.lit(0.0)).cast("bigint").alias("total_sales"),
        F.countDistinct("product_id").alias("active_products"),
    )


def history(panel: DataFrame, *, store_id: str, product_id: str) -> DataFrame:
    """B2: one series in date order."""
    chosen = panel.where((F.col("store_id") == store_id) & (F.col("product_id") == product_id))
    return chosen.select("date", "sales").orderBy("date")


def dimension_counts(df: DataFrame) -> DataFrame:
    """B3"""
    return df.agg(F.countDistinct("store_id").alias("stores"), F.countDistinct("product_id").alias("products"))


def first_records(records: DataFrame, n: int = 4) -> DataFrame:
    """The first records in series and date order."""
    return records.orderBy("store_id", "product_id", "date").limit(n)


def profile(df: DataFrame) -> DataFrame:
    """Size, range, distinct keys and shares of a sales table in one pass."""
    share = {
        name: (F.sum(F.col(name).cast("double")) / F.count(F.lit(1)) * 100).alias(f"{name}_percent")
        for name in ("promotion", "holiday")
        if name in df.columns
    }
    counts = {
        label: F.countDistinct(column).alias(label)
        for label, column in (("stores", "store_id"), ("products", "product_id"), ("categories", "category"))
        if column in df.columns
    }
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        *counts.values(),
        F.avg("sales").alias("mean_sales"),
        F.sum("sales").alias("total_sales"),
        *share.values(),
    )
