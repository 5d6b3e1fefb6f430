from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_exchange import actions_table, fold_by_hand

from shelfcast.operators import anomaly, inventory
from shelfcast.streaming import sales, transfers
from shelfcast.streaming.sources import file_stream, newest, run_available

SALE = "store_id string, product_id string, ts timestamp, sales double, price double"


def write_in_turn(spark, frames, path):
    """One file after another, so that the stream takes them in this order."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)


def sale(day, hour, sales=1.0, price=5.0, product="P"):
    return ("S", product, datetime(2026, 1, 1) + timedelta(days=day, hours=hour), sales, price)


def test_daily_totals_wait_for_late_events_and_drop_later_ones(spark, tmp_path):
    path = str(tmp_path / "in")
    first = [sale(0, 1), sale(0, 2), sale(1, 3)]
    second = [sale(0, 23), sale(5, 1)]
    third, fourth = [sale(5, 2)], [sale(0, 5), sale(5, 3)]
    write_in_turn(spark, [spark.createDataFrame(rows, SALE) for rows in (first, second, third, fourth)], path)
    stream = file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    out = run_available(sales.daily_totals(stream), str(tmp_path / "out")).orderBy("date").collect()
    # The second file is a day late and counts; the fourth comes after the watermark closed that day.
    assert [(r.date.day, r.events, r.sales) for r in out] == [(1, 3, 3.0), (2, 1, 1.0)]


def test_rule_flags_equal_the_batch_rules(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [sale(0, 1, 5.0), sale(1, 1, 50.0), sale(2, 1, 5.0, 0.0), sale(3, 1, None), sale(4, 1, 500.0, product="new")]
    spark.createDataFrame(rows, SALE).write.parquet(path)
    bounds = spark.createDataFrame([("S", "P", 20.0)], "store_id string, product_id string, base_upper double")
    batch = sales.rule_flags(spark.read.parquet(path), bounds)
    stream = file_stream(spark, path, spark.read.parquet(path).schema)
    live = run_available(sales.rule_flags(stream, bounds), str(tmp_path / "out"))
    kinds = {r.ts.day: r.anomaly_type for r in live.collect()}
    assert kinds == {2: "DEMAND_SPIKE", 3: "CRITICAL_DATA_ERROR", 4: "MISSING_DATA"}
    assert sorted(map(str, batch.collect())) == sorted(map(str, live.collect()))


def test_transfer_states_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rows, df = actions_table(spark, n=30, hot=40)
    end = datetime(2026, 1, 3)
    closing = spark.createDataFrame([("end", end, 10**9, "ACCEPT")], df.schema)
    path = str(tmp_path / "in")
    # Files hold shuffled times: every file overlaps every other.
    parts = [df.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i) for i in range(4)]
    write_in_turn(spark, [*parts, closing], path)
    stream = file_stream(spark, path, df.schema, files_per_trigger=1)
    states = transfers.transfer_states(stream, delay="12 hours")
    got = {r.transfer_id: r.state for r in newest(run_available(states, str(tmp_path / "out"), mode="update"), ["transfer_id"]).collect()}
    moving = {r[0] for r in rows if r[3] in ("ACCEPT", "CONFIRM", "COMPLETE")}
    want = {k: s for k, s in fold_by_hand(rows).items() if k in moving}
    assert got == want


def test_a_transfer_goes_on_after_a_hundred_days(spark, tmp_path):
    schema = "transfer_id string, ts timestamp, event_id long, action string"
    start = datetime(2026, 1, 1)
    days = [[("t", 0, 1, "ACCEPT"), ("u", 0, 2, "ACCEPT")], [("x", 50, 3, "ACCEPT")], [("x", 99, 4, "CONFIRM")], [("t", 100, 5, "CONFIRM")], [("x", 120, 6, "COMPLETE")], [("y", 130, 7, "ACCEPT")]]
    for i, rows in enumerate(days):
        made = [(t, start + timedelta(days=d), n, a) for t, d, n, a in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = file_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema, files_per_trigger=1)
    found = newest(run_available(transfers.transfer_states(stream), str(tmp_path / "out"), mode="update"), ["transfer_id"])
    states = {r.transfer_id: r.state for r in found.collect()}
    assert (states["t"], states["x"], states["u"]) == ("IN_TRANSIT", "COMPLETED", "ACCEPTED")


ACTION = "transfer_id string, ts timestamp, event_id long, action string"


def transfers_of(spark, tmp_path, files, **options):
    """States of transfers after files of ``(transfer, day, event_id, action)`` in turn, and the most rows the state had."""
    for i, rows in enumerate(files):
        made = [(t, None if d is None else datetime(2026, 1, 1) + timedelta(days=d), n, a) for t, d, n, a in rows]
        spark.createDataFrame(made, ACTION).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = file_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], ACTION).schema, files_per_trigger=1)
    moved, held = {}, []

    def keep(batch, _):
        moved.update({r.transfer_id: r.state for r in batch.collect()})

    writer = transfers.transfer_states(stream, **options).writeStream.outputMode("update").foreachBatch(keep)
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    for progress in query.recentProgress:
        held += [op["numRowsTotal"] for op in progress["stateOperators"]]
    return moved, max(held)


def test_transfers_share_a_state_and_a_call(spark, tmp_path):
    steps = ["ACCEPT", "CONFIRM", "COMPLETE"]
    first = [(f"t{i}", 0, 10 * i + k, a) for i in range(300) for k, a in enumerate(steps[: 1 + i % 3])]
    second = [("t0", 5, 10_000, "CONFIRM"), ("t1", 5, 10_001, "ACCEPT"), ("end", 9, 10_002, "ACCEPT")]
    moved, held = transfers_of(spark, tmp_path, [first, second], shards=8)
    want = {f"t{i}": ("ACCEPTED", "IN_TRANSIT", "COMPLETED")[i % 3] for i in range(300)} | {"t0": "IN_TRANSIT"}
    assert moved == want
    assert held <= 8


def test_actions_without_a_time_never_count_and_those_without_an_id_come_last(spark, tmp_path):
    rows = [("t", 0, None, "ACCEPT"), ("t", 0, 1, "CONFIRM"), ("u", None, 2, "ACCEPT"), ("u", 0, 3, "CONFIRM"), (None, 0, 4, "ACCEPT")]
    moved, _ = transfers_of(spark, tmp_path, [[*rows, ("end", 9, 5, "ACCEPT")]], shards=1)
    assert moved == {"t": "ACCEPTED", "u": "REQUESTED", None: "ACCEPTED"}


def test_an_idle_transfer_ends_and_its_neighbours_go_on(spark, tmp_path):
    files = [[("a", 0, 1, "ACCEPT"), ("b", 0, 2, "ACCEPT")], [("b", 8, 3, "CONFIRM")], [("x", 16, 4, "ACCEPT")], [("y", 22, 5, "ACCEPT")]]
    files += [[("z", 22, 6, "ACCEPT")], [("a", 22, 7, "CONFIRM"), ("b", 22, 8, "COMPLETE")], [("end", 25, 9, "ACCEPT")]]
    moved, _ = transfers_of(spark, tmp_path, files, shards=1, keep_days=12)
    assert (moved["a"], moved["b"]) == ("REQUESTED", "COMPLETED")


def test_alert_table(spark, tmp_path):
    path = str(tmp_path / "items")
    items = spark.createDataFrame(
        [("S", f"P{i}", i * 10, 70, 7) for i in range(10)],
        "store_id string, product_id string, current_stock bigint, forecast_demand bigint, forecast_horizon bigint",
    )
    items.write.parquet(path)
    decided = inventory.decide(file_stream(spark, path, items.schema))
    transfers.write_alerts(decided, str(tmp_path / "alerts"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "alerts")).drop("_batch")
    want = inventory.alerts(inventory.decide(items))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 0


def test_bounds_of_the_batch_serve_the_stream(spark):
    days = spark.createDataFrame([("S", "P", float(v)) for v in (1, 2, 3, 4, 100)], "store_id string, product_id string, sales double")
    assert anomaly.demand_bounds(days).first().base_upper == 7.0
