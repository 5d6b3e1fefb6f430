"""The streaming operators, run over everything in the tables' files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.catalog import Entry, plain, rounded
from shelfcast.catalog.data import steady
from shelfcast.catalog.sql import query, r
from shelfcast.catalog.stock import _ALERT
from shelfcast.functions.keys import SERIES
from shelfcast.operators import anomaly, clean, inventory
from shelfcast.session import materialise
from shelfcast.sources import retail
from shelfcast.streaming import sales as stream_sales
from shelfcast.streaming import history, transfers
from shelfcast.streaming.sinks import keep_newest
from shelfcast.streaming.sources import event_time, file_stream, newest, run_available, scratch

ENTRIES: dict[str, Entry] = {}


def entry(name: str, sql: str | None = None):
    def add(run):
        ENTRIES[name] = Entry(lambda spark, folder: plain(run(spark, folder)), sql)
        return run

    return add


def table_stream(spark, folder, name: str) -> DataFrame:
    return file_stream(spark, folder, retail.table(spark, folder, name).schema, pattern=f"{name}.parquet")


@entry(
    "w01_daily_totals",
    f"""
SELECT * FROM (SELECT CAST(ts AS DATE) AS date, user_id, event_type, count(*) AS events, {r('sum(value)')} AS sales FROM events GROUP BY ALL)
WHERE CAST(date + 1 AS TIMESTAMP) <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM events)
""",
)
def _(spark, folder):
    """Days that ended before the watermark, by user and event type."""
    events = event_time(table_stream(spark, folder, "events"))
    totals = stream_sales.daily_totals(events, ["user_id", "event_type"], value="value")
    return rounded(run_available(totals, scratch(spark, "w01")))


@entry(
    "w01_all_days",
    f"SELECT CAST(ts AS DATE) AS date, user_id, event_type, count(*) AS events, {r('sum(value)')} AS sales FROM events GROUP BY ALL",
)
def _(spark, folder):
    """Every day, the last ones as they stand: the stream in update mode, newest row of each key."""
    events = event_time(table_stream(spark, folder, "events"))
    totals = stream_sales.daily_totals(events, ["user_id", "event_type"], value="value")
    updates = run_available(totals, scratch(spark, "w01"), mode="update")
    return rounded(newest(updates, ["date", "user_id", "event_type"]))


@entry(
    "w01_newest_table",
    f"SELECT CAST(ts AS DATE) AS date, user_id, event_type, count(*) AS events, {r('sum(value)')} AS sales FROM events GROUP BY ALL",
)
def _(spark, folder):
    """Every day in the table of newest rows, in which a repeated batch counts once."""
    events = event_time(table_stream(spark, folder, "events"))
    totals = stream_sales.daily_totals(events, ["user_id", "event_type"], value="value")
    table = keep_newest(totals, scratch(spark, "w01"), ["date", "user_id", "event_type"])
    return rounded(table.read())


@entry(
    "w02_rule_flags",
    query(
        "raw fences",
        """
, b AS (SELECT *, (q3 + 1.5 * (q3 - q1)) * CASE WHEN disc > 0 THEN 2 ELSE 1 END * CASE WHEN isodow(date) >= 6 THEN CAST(1.2 AS DOUBLE) ELSE 1 END AS bound
        FROM (SELECT store_id, product_id, date, sales, price - 420 AS price, disc FROM raw) JOIN fences USING (store_id, product_id)),
 f AS (SELECT *, least(1, sales / (bound + 1e-5::DOUBLE)) AS ratio, sales > bound AS spike FROM b)
SELECT store_id, product_id, date, anomaly_type, count(*) AS n, round(sum(score), 2) AS score FROM (
 SELECT store_id, product_id, date, CASE WHEN price <= 0 THEN 'CRITICAL_DATA_ERROR' WHEN spike AND disc > 0 THEN 'BUSINESS_EVENT' ELSE 'DEMAND_SPIKE' END AS anomaly_type,
        CASE WHEN price <= 0 THEN 1 WHEN spike AND disc > 0 THEN 0.4::DOUBLE ELSE round_even(ratio, 2) END AS score FROM f WHERE price <= 0 OR spike)
GROUP BY ALL
""",
    ),
)
def _(spark, folder):
    """Line items as they come, against the bounds of the daily table."""
    part = retail.table(spark, folder, "part").select("p_partkey", "p_brand")
    lines = table_stream(spark, folder, "lineitem")
    rows = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(retail.store_regions(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("r_name").alias("store_id"),
            F.col("p_brand").alias("product_id"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_quantity").alias("sales"),
            (retail.unit_price() - 420).alias("price"),
            (F.col("l_discount") > 0).cast("int").alias("is_promotion"),
            F.weekday(F.col("l_shipdate").cast("date")).alias("day_of_week"),
        )
    )
    # Written once: a micro-batch reads a row per series, not the sales again.
    bounds = materialise(anomaly.demand_bounds(clean.daily(retail.sales(spark, folder))), "bounds")
    flags = run_available(stream_sales.rule_flags(rows, bounds), scratch(spark, "w02"))
    return flags.groupBy(*SERIES, "date", "anomaly_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("anomaly_score"), 2).alias("score")
    )


@entry(
    "w02_history_flags",
    query(
        "y_flagged",
        """
SELECT store_id, product_id, date, f.t AS anomaly_type, f.s AS anomaly_severity, f.v AS anomaly_score, f.r AS anomaly_reason
FROM y_flagged WHERE date <= (SELECT max(date) - 2 FROM y_flagged)
""",
    ),
)
def _(spark, folder):
    """Daily rows in which every finding occurs, as a stream: each row against the ring of its series, up to the watermark."""
    path = scratch(spark, "w02")
    rows = materialise(steady(spark, folder), "steady")
    bounds = materialise(anomaly.demand_bounds(rows), "bounds")
    daily = rows.select(*SERIES, F.col("date").cast("timestamp").alias("ts"), "sales", "price", "current_stock", "is_promotion")
    daily.write.parquet(f"{path}/rows-in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, history.ROCKSDB)
    try:
        stream = file_stream(spark, f"{path}/rows-in", daily.schema)
        return run_available(history.history_flags(stream, bounds), path).drop("sales")
    finally:
        spark.conf.set(provider, before)


@entry(
    "w03_transfer_states",
    query(
        "",
        """
WITH a AS (SELECT user_id || '_' || strftime(ts, '%Y%m%d') AS transfer_id, ts, event_id, event_type FROM events
           WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events WHERE event_type IN ('click', 'signup', 'purchase'))
             AND event_type IN ('click', 'signup', 'purchase')),
acc AS (SELECT transfer_id, min((ts, event_id)) AS t0 FROM a WHERE event_type = 'click' GROUP BY transfer_id),
conf AS (SELECT a.transfer_id, min((ts, event_id)) AS t1 FROM a JOIN acc USING (transfer_id) WHERE event_type = 'signup' AND (ts, event_id) > t0 GROUP BY a.transfer_id),
comp AS (SELECT a.transfer_id, min((ts, event_id)) AS t2 FROM a JOIN conf USING (transfer_id) WHERE event_type = 'purchase' AND (ts, event_id) > t1 GROUP BY a.transfer_id)
SELECT transfer_id, CASE WHEN t2 IS NOT NULL THEN 'COMPLETED' WHEN t1 IS NOT NULL THEN 'IN_TRANSIT' WHEN t0 IS NOT NULL THEN 'ACCEPTED' ELSE 'REQUESTED' END AS state
FROM (SELECT DISTINCT transfer_id FROM a) LEFT JOIN acc USING (transfer_id) LEFT JOIN conf USING (transfer_id) LEFT JOIN comp USING (transfer_id)
""",
    ),
)
def _(spark, folder):
    """Actions the watermark has passed, applied in time order."""
    events = event_time(table_stream(spark, folder, "events"))
    states = transfers.transfer_states(retail.as_actions(events))
    return newest(run_available(states, scratch(spark, "w03"), mode="update"), ["transfer_id"])


@entry("w04_alert_table", query("i_decisions", f"{_ALERT} FROM i_decisions WHERE stock_status IN ('REORDER', 'CRITICAL')"))
def _(spark, folder):
    """Items arriving as a stream, decided and appended to the alert table."""
    path = scratch(spark, "w04")
    items = retail.items(spark, folder)
    items.write.parquet(f"{path}/items")
    stream = file_stream(spark, f"{path}/items", items.schema)
    transfers.write_alerts(inventory.decide(stream), f"{path}/alerts", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/alerts").drop("_batch")
