"""Registered queries: for each name a Spark query and, where SQL can say it, the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, so that results compare across engines."""
    wide = {"byte": "bigint", "short": "bigint", "integer": "bigint", "float": "double"}
    kinds = {f.name: wide.get(f.dataType.typeName()) for f in df.schema.fields}
    return df.selectExpr(*[f"CAST(`{c}` AS {k}) AS `{c}`" if k else f"`{c}`" for c, k in kinds.items()])


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Computed fractions rounded for comparison."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.selectExpr(*[f"round(`{c}`, {digits}) AS `{c}`" if k == "double" else f"`{c}`" for c, k in kinds.items()])


def collect_entries() -> dict[str, Entry]:
    from shelfcast.catalog import data, forecasting, monitoring, stock, streams

    entries: dict[str, Entry] = {}
    for module in (data, forecasting, monitoring, stock, streams):
        entries.update(module.ENTRIES)
    return entries
