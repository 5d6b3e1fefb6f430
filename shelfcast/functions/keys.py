"""Names and windows every operator shares.

A *series* is one ``(store_id, product_id)`` pair.  After the daily aggregate a
series holds at most one row per calendar day, so a window over one series is
bounded by the length of the calendar however many raw rows the series had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec

SERIES = ["store_id", "product_id"]


def by_date(*tiebreak: str) -> WindowSpec:
    return Window.partitionBy(*SERIES).orderBy("date", *tiebreak)


def whole_series(*extra: str) -> WindowSpec:
    """All rows of a series; extra keys stay within the same shuffle partitioning."""
    return Window.partitionBy(*SERIES, *extra)


def by_series(df: DataFrame) -> DataFrame:
    """Rows of a series together, over all shuffle partitions.

    For rows that will grow after the shuffle: sized by what is shuffled, adaptive
    execution would merge them into too few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *SERIES)
