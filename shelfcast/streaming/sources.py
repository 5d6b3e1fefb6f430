"""Streams over folders of files, and running them to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfcast.session import ensure_checkpoint_dir


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, *, pattern: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone; naive times are taken in the session's zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfcast-{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, path: str, *, mode: str = "append") -> DataFrame:
    """Process everything present, write parquet files under ``path``, and read them back.

    Append streams use the file sink.  Update streams append every batch with its
    number in ``_batch``, so that the newest row of a key can be told; a batch that
    is run again after a failure replaces its own folder.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    rows = f"{path}/rows"
    if mode == "append":
        query = writer.format("parquet").option("path", rows).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{rows}/_batch={n}")).start()
    query.awaitTermination()
    return spark.read.schema(_with_batch(stream.schema) if mode != "append" else stream.schema).parquet(rows)


def _with_batch(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("_batch", "long")


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key of an update stream."""
    rest = [c for c in updates.columns if c not in keys and c != "_batch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
