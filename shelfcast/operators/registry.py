"""Model registry as a table of events.

Rows are only ever appended: ``REGISTER`` makes a version the one in production,
``ROLLBACK`` returns to the newest archived one.  What is live follows from the
events: registering puts a version on top of the series' pile, rolling back takes
the top off unless it is the only one left.  So the state after each event is the
height of the pile, a running sum that is held at 1 from below, and a version is
gone once a later height is lower than its own.

Heights are computed in two levels (days, then events within the day), so that a
series with very many events is ordered day by day, not in one piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES

EVENT_COLUMNS = [*SERIES, "version_id", "event", "at", "seq"]


def heights(events: DataFrame) -> DataFrame:
    """Each event with the height of the pile after it (0 before the first version)."""
    registers = F.col("event") == "REGISTER"
    in_day = Window.partitionBy(*SERIES, "_day").orderBy("at", "seq")
    upto = in_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moves = events.withColumn("_day", F.to_date("at")).withColumns(
        {
            "_sum": F.sum(F.when(registers, 1).otherwise(-1)).over(upto),
            "_known": F.count_if(registers).over(upto),
        }
    )
    # The floor holds from the first registration on: lowest sums with and without earlier rows.
    moves = moves.withColumns(
        {
            "_low": F.min("_sum").over(upto),
            "_low_known": F.min(F.when(F.col("_known") > 0, F.col("_sum"))).over(upto),
        }
    )
    days = moves.groupBy(*SERIES, "_day").agg(
        F.sum(F.when(registers, 1).otherwise(-1)).alias("_total"),
        F.max("_known").alias("_registered"),
        F.min("_sum").alias("_floor"),
        F.min("_low_known").alias("_floor_known"),
    )
    earlier = Window.partitionBy(*SERIES).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns(
        {
            "_before": F.coalesce(F.sum("_total").over(earlier), F.lit(0)),
            "_known_before": F.coalesce(F.sum("_registered").over(earlier), F.lit(0)),
        }
    )
    floor = F.when(F.col("_known_before") > 0, F.col("_floor")).otherwise(F.col("_floor_known"))
    days = days.withColumn("_lowest_before", F.min(F.col("_before") + floor).over(earlier)).select(
        *SERIES, "_day", "_before", "_known_before", "_lowest_before"
    )
    placed = moves.join(days, [*SERIES, "_day"])
    low = F.when(F.col("_known_before") > 0, F.col("_low")).otherwise(F.col("_low_known"))
    lifted = F.greatest(F.lit(0), 1 - F.least(F.col("_lowest_before"), F.col("_before") + low))
    live = F.col("_known_before") + F.col("_known") > 0
    height = F.when(live, F.col("_before") + F.col("_sum") + lifted).otherwise(0)
    return placed.withColumn("height", height.cast("bigint")).select(*events.columns, "height", "_day")


def versions(events: DataFrame) -> DataFrame:
    """Every registered version with its status: PRODUCTION, ARCHIVED or ROLLED_BACK."""
    placed = heights(events)
    # Later rows are looked at in descending order: a frame that grows is linear.
    newest_first = Window.partitionBy(*SERIES, "_day").orderBy(F.desc("at"), F.desc("seq"))
    later_today = F.min("height").over(newest_first.rowsBetween(Window.unboundedPreceding, -1))
    by_day = placed.groupBy(*SERIES, "_day").agg(
        F.min("height").alias("_lowest"), F.max_by("height", F.struct("at", "seq")).alias("_end")
    )
    after = Window.partitionBy(*SERIES).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    all_days = Window.partitionBy(*SERIES)
    by_day = by_day.withColumn("_later", F.min("_lowest").over(after)).withColumn(
        "_final", F.max_by("_end", "_day").over(all_days)
    )
    registered = placed.withColumn("_today", later_today).where(F.col("event") == "REGISTER")
    seen = registered.join(by_day.select(*SERIES, "_day", "_later", "_final"), [*SERIES, "_day"])
    lowest_later = F.least("_today", "_later")
    return seen.select(
        *[c for c in events.columns if c != "event"],
        F.when(F.coalesce(lowest_later < F.col("height"), F.lit(False)), "ROLLED_BACK")
        .when(F.col("height") == F.col("_final"), "PRODUCTION")
        .otherwise("ARCHIVED")
        .alias("status"),
    )


def production(events: DataFrame) -> DataFrame:
    """The live version of each series."""
    return versions(events).where(F.col("status") == "PRODUCTION").drop("status")


def register(events: DataFrame, new: DataFrame) -> DataFrame:
    """G1: the event rows to append for newly trained models."""
    return new.select(*SERIES, "version_id", F.lit("REGISTER").alias("event"), "at", "seq")


def rollback(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """The event rows to append for series ``(series, at, seq)`` that have an archived version."""
    possible = versions(events).where(F.col("status") == "ARCHIVED").select(*SERIES).distinct()
    return wanted.join(possible, SERIES, "left_semi").select(
        *SERIES, F.lit(None).cast("string").alias("version_id"), F.lit("ROLLBACK").alias("event"), "at", "seq"
    )


# --- as of a time -----------------------------------------------------------------------------


def timeline(events: DataFrame) -> DataFrame:
    """Each event with ``live_version``, the version in production after it (null before the first).

    That is the newest version registered at the height the pile has now: versions above it are
    gone, and an older one at its height went before it came.  Looked up within the day first, then
    among day ends, so that a series with very many events is ordered day by day.
    """
    placed = heights(events)
    registered = F.when(F.col("event") == "REGISTER", F.col("version_id"))
    level = [*SERIES, "height"]
    in_day = Window.partitionBy(*level, "_day").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    today = placed.withColumn("_today", F.last(registered, True).over(in_day))
    ends = placed.groupBy(*level, "_day").agg(F.max_by(registered, F.when(F.col("event") == "REGISTER", F.struct("at", "seq"))).alias("_end"))
    earlier = Window.partitionBy(*level).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*level, "_day", F.last("_end", True).over(earlier).alias("_before"))
    live = F.when(F.col("height") > 0, F.coalesce("_today", "_before"))
    return today.join(ends, [*level, "_day"]).withColumn("live_version", live).select(*events.columns, "height", "live_version", "_day")


def serving(rows: DataFrame, events: DataFrame) -> DataFrame:
    """``rows`` (series, ``at``, ``seq``, other columns) with ``version_id``: what was in production at their time.

    An as-of join without a range join: rows and events of a series lie in one order, and each row takes
    the last event before it, of its day or else of the last day with any.  Events at the row's
    very time with a smaller or equal ``seq`` count.  Rows of unknown series, or before the first
    version, get null; repeated rows each get their answer.  ``rows`` may not have a ``version_id`` of its own.
    """
    if "version_id" in rows.columns:
        raise ValueError("version_id is already a column")
    live = timeline(events).select(*SERIES, "_day", "at", "seq", F.lit(0).alias("_kind"), "live_version")
    asked = rows.select(
        *SERIES,
        F.to_date("at").alias("_day"),
        "at",
        "seq",
        F.lit(1).alias("_kind"),
        F.lit(None).cast("string").alias("live_version"),
        F.struct(*rows.columns).alias("_row"),
    )
    together = live.unionByName(asked, allowMissingColumns=True)
    event = F.col("_kind") == 0
    in_day = Window.partitionBy(*SERIES, "_day").orderBy("at", "seq", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The last event decides even where it left nothing in production: its answer is kept in a struct.
    told = F.when(event, F.struct("live_version"))
    today = together.withColumn("_today", F.last(told, True).over(in_day)).where(~event)
    days = together.groupBy(*SERIES, "_day").agg(F.max_by(told, F.when(event, F.struct("at", "seq"))).alias("_end"))
    earlier = Window.partitionBy(*SERIES).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*SERIES, "_day", F.last("_end", True).over(earlier).alias("_before"))
    found = today.join(days, [*SERIES, "_day"], "left")
    return found.select("_row.*", F.coalesce("_today", "_before")["live_version"].alias("version_id"))
