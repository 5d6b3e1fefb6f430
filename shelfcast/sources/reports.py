"""Writing and reading stored reports and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfcast.functions.keys import SERIES


def write_reports(reports: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One JSON document per series, in folders by store.

    The folder level is the store only: one folder per series would leave the
    file system with as many folders as there are series.  Rows are spread by
    series before writing so that a store with many products gets several files.
    """
    (
        reports.withColumn("store", F.col("store_id"))
        .repartition(*SERIES)
        .write.mode(mode)
        .partitionBy("store")
        .option("ignoreNullFields", False)
        .json(path)
    )


def read_report(
    spark: SparkSession, path: str, schema: StructType, *, store_id: str, product_id: str
) -> DataFrame:
    """The stored report of one series; no rows when there is none."""
    with_folder = StructType([*schema.fields, StructField("store", StringType())])
    stored = spark.read.schema(with_folder).json(path)
    return stored.where((F.col("store") == store_id) & (F.col("product_id") == product_id)).drop("store")


def write_reference_snapshot(validation_rows: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Keep each series' validation slice as the later drift reference."""
    (
        validation_rows.withColumn("store", F.col("store_id"))
        .repartition(*SERIES)
        .sortWithinPartitions(*SERIES, "date")
        .write.mode(mode)
        .partitionBy("store")
        .parquet(path)
    )


def read_reference_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("store")
