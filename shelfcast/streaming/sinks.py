"""A table that keeps the newest row of each key of an update stream.

Keys fall into buckets.  A batch rewrites the buckets it touches as new files and then publishes a
small manifest that says which batch wrote each bucket last; only a published manifest is read.  A
batch that is repeated starts from the manifest before it and writes the same again, and one that
fails leaves the table as it was, so every batch counts exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of the table that are rewritten by themselves: more of them for larger tables.
BUCKETS = 32

_MANIFEST = "bucket int, written bigint"


@dataclass
class NewestTable:
    """The table under ``path``: the row of each key with the largest ``order`` (default: the newest batch).

    Rows of one batch that are equal in ``order`` are told apart by their other columns, the
    largest wins; null keys are keys like others.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: Sequence[str]
    order: Sequence[str] = ()
    buckets: int = BUCKETS

    def _fs(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _published(self) -> list[int]:
        """Numbers of the batches whose manifest is complete."""
        path, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(path):
            return []
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(path)]
        return sorted(n for n in numbers if fs.exists(self._fs(f"{self.path}/manifests/{n}/_SUCCESS")[0]))

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """The newest manifest, or that before a batch: bucket to the batch that wrote it (``buckets`` rows at most)."""
        numbers = [n for n in self._published() if before is None or n < before]
        if not numbers:
            return {}
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/{numbers[-1]}").collect()
        return {r.bucket: r.written for r in rows}

    def _rows(self, manifest: dict[int, int], wanted: Sequence[int] | None = None) -> DataFrame | None:
        kept = {b: n for b, n in manifest.items() if wanted is None or b in wanted}
        if not kept:
            return None
        paths = [f"{self.path}/data/{n}/_bucket={b}" for b, n in sorted(kept.items())]
        return self.spark.read.schema(self._inner()).parquet(*paths)

    def _inner(self) -> StructType:
        return StructType([*self.schema.fields]).add("_batch", "long")

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in (*self.schema.names, "_batch") if c not in self.keys]
        order = F.struct(*(self.order or ["_batch"]), "_batch", *[c for c in rest if c != "_batch"])
        picked = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
        return picked.select(*self.keys, "_r.*")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in a batch; the same ``number`` again changes nothing."""
        known = self._manifest(before=number)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = batch.select(*self.schema.names).withColumn("_batch", F.lit(number).cast("long"))
        new = self._newest(new).select(*self._inner().names)
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # ``buckets`` rows at most
        old = self._rows(known, touched)
        rows = new if old is None else self._newest(old.unionByName(new))
        rows.withColumn("_bucket", bucket).write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.path}/data/{number}")
        manifest = sorted((known | dict.fromkeys(touched, number)).items())
        self._publish(manifest, number)

    def _publish(self, manifest: list[tuple[int, int]], number: int) -> None:
        made = self.spark.createDataFrame(manifest, _MANIFEST).coalesce(1)
        made.write.mode("overwrite").json(f"{self.path}/manifests/{number}")

    def read(self) -> DataFrame:
        """The newest row of every key, as of the last published batch."""
        rows = self._rows(self._manifest())
        rows = self.spark.createDataFrame([], self._inner()) if rows is None else rows
        return rows.select(*self.schema.names)

    def clean(self) -> None:
        """Delete what no manifest but the last two speaks of; for times without readers of older states."""
        numbers = self._published()
        used = {n for number in numbers[-2:] for n in self._manifest(before=number + 1).values()}
        for n in numbers:
            if n not in used and n not in numbers[-2:]:
                path, fs = self._fs(f"{self.path}/data/{n}")
                fs.delete(path, True)
        for n in numbers[:-2]:
            path, fs = self._fs(f"{self.path}/manifests/{n}")
            fs.delete(path, True)


def keep_newest(
    updates: DataFrame, path: str, keys: Sequence[str], *, order: Sequence[str] = (), buckets: int = BUCKETS,
    after: Callable[[int], None] | None = None,
) -> NewestTable:
    """Run an update stream over everything present into a table of the newest rows; ``after`` is called with each batch's number."""
    table = NewestTable(updates.sparkSession, f"{path}/table", updates.schema, list(keys), list(order), buckets)

    def take(batch: DataFrame, number: int) -> None:
        table.merge(batch, number)
        if after is not None:
            after(number)

    query = (
        updates.writeStream.outputMode("update")
        .foreachBatch(take)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table
