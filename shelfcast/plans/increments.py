"""The panel and its features day by day (P10-P13, F3-F9), without the days before.

A table keeps what coming days need of every series: its last 28 panel days and a few
counters.  It is bucketed by series, so new days are shuffled to it and it stays where it is;
the rows of a series then meet in one place, grow and get their features by the same operators
as a full build.  The table moves on by rewriting series that have news.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES
from shelfcast.operators.clean import CARRIED, densify
from shelfcast.operators.features import LAGS, MEAN_WINDOWS, engineer
from shelfcast.session import ensure_checkpoint_dir

#: Days a series has to keep: the longest lag or window.
KEPT_DAYS = max(*LAGS, *MEAN_WINDOWS)


def _kept(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per series from its dense rows (bounded by the calendar): its newest days, oldest first, and counters."""
    days = F.array_sort(F.collect_list(F.struct("date", *columns)))
    return rows.groupBy(*SERIES).agg(
        F.slice(days, F.greatest(F.size(days) - (KEPT_DAYS - 1), F.lit(1)), F.lit(KEPT_DAYS)).alias("recent"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("days"),
        F.sum("sales").cast("double").alias("total"),
    )


@dataclass
class PanelState:
    """A written state table; ``advance`` gives the rows that new days add and the table after them."""

    spark: SparkSession
    name: str
    path: str
    columns: list[str]
    parts: int

    @classmethod
    def start(cls, panel: DataFrame) -> PanelState:
        """The state after a dense panel (or an empty one, to begin with)."""
        columns = [c for c in panel.columns if c in ("sales", "promotion", *CARRIED)]
        parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cls._written(panel.sparkSession, _kept(panel, columns), columns, parts)

    @classmethod
    def _written(cls, spark: SparkSession, rows: DataFrame, columns: list[str], parts: int) -> PanelState:
        name = f"panel_state_{uuid.uuid4().hex}"
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
        rows.write.format("parquet").bucketBy(parts, *SERIES).sortBy(*SERIES).option("path", path).saveAsTable(name)
        return cls(spark, name, path, columns, parts)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _grown(self, days: DataFrame) -> DataFrame:
        """Kept and new days of the series with news, dense, where their state lies; ``_old`` is the last day known before.

        New days at or before a series' last one are late and left out.
        """
        news = days.groupBy(*SERIES).agg(F.collect_list(F.struct("date", *self.columns)).alias("_news"))  # the days of one run
        # The larger side keeps its buckets: a plain join would choose either.
        met = news.hint("merge").join(self.read().drop("days", "total"), SERIES, "left")
        fresh = F.filter("_news", lambda d: F.col("last_date").isNull() | (d["date"] > F.col("last_date")))
        kept = F.coalesce(F.col("recent"), F.expr("slice(_news, 1, 0)"))
        rows = met.select(*SERIES, F.col("last_date").alias("_old"), fresh.alias("_fresh"), kept.alias("_kept"))
        rows = rows.where(F.size("_fresh") > 0)
        rows = rows.select(*SERIES, "_old", F.inline(F.concat("_kept", "_fresh")))
        dense = densify(rows.drop("_old"), placed=True)
        first_new = rows.groupBy(*SERIES).agg(F.max("_old").alias("_old"))
        return dense.join(first_new, SERIES)

    def rows(self, days: DataFrame) -> DataFrame:
        """The panel rows with features that daily rows ``days`` add: theirs, and the empty days before them.

        ``days`` has the columns of the panel the state was made of and one row per series and day;
        several days at once give what they give one by one.  Prices and the like are carried on; what
        is missing in a series' very first rows stays missing.
        """
        made = engineer(self._grown(days))
        return made.where(F.col("_old").isNull() | (F.col("date") > F.col("_old"))).drop("_old")

    def after(self, days: DataFrame) -> PanelState:
        """The state after ``days``, as a new table; series without news keep their row."""
        grown = self._grown(days)
        new = grown.where(F.col("_old").isNull() | (F.col("date") > F.col("_old")))
        added = new.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_days"), F.sum("sales").cast("double").alias("_total"))
        kept = _kept(grown.drop("_old"), self.columns).drop("days", "total").join(added, SERIES)
        known = self.read().select(*SERIES, "days", "total")
        changed = kept.join(known, SERIES, "left").select(
            *SERIES,
            "recent",
            "last_date",
            (F.coalesce("days", F.lit(0)) + F.col("_days")).alias("days"),
            (F.coalesce("total", F.lit(0.0)) + F.col("_total")).alias("total"),
        )
        unchanged = self.read().join(changed.select(*SERIES), SERIES, "left_anti")
        return self._written(self.spark, unchanged.unionByName(changed), self.columns, self.parts)
