"""Session helpers shared by tests, the bench and long-running plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, *, app: str = "shelfcast", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        # Recording the Python line of every column call costs milliseconds each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; set one only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="shelfcast-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_written: list[str] = []


def drop_written(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables ``materialise`` wrote in this process (from the ``since``-th on).

    The owner of a run calls it once its results are stored: frames that read the tables
    are of no use afterwards.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_written) > since:
        path = hadoop(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def run_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block are deleted at its end."""
    mark = len(_written)
    try:
        yield
    finally:
        drop_written(spark, mark)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Plans that use a frame several times read the columns they need from the
    files instead of computing it again, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfcast-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
