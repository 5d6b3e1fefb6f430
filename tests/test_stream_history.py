"""The stream with history against the batch scan, rows out of order, and expiry."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import anomaly
from shelfcast.streaming.history import ROCKSDB, history_flags, measured
from shelfcast.streaming.sources import file_stream, run_available

START = date(2026, 1, 1)
SCHEMA = "store_id string, product_id string, ts timestamp, sales double, price double, current_stock long, is_promotion int"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, before)


def rows(n=60):
    """Steady sales with every kind of event."""
    out = []
    for k in range(3):
        for i in range(n):
            e = (i * 7 + k) % 23 if i > 12 else 20
            base = 40 + (i * 13 + k) % 9
            sales = {0: base * 30.0, 1: base * 30.0, 2: 0.0, 3: None, 8: base * 1.9}.get(e, float(base))
            price = {4: 0.0, 5: 50.0}.get(e, 10.0)
            stock = {6: -5, 7: 3000}.get(e, 500)
            out.append((f"S{k}", "P", datetime(2026, 1, 1) + timedelta(days=i), sales, price, stock, int(e == 1)))
    return out


def streamed(spark, path, given, bounds, files, run=history_flags, **options):
    for i, part in enumerate(files):
        spark.createDataFrame([given[j] for j in part], SCHEMA).coalesce(1).write.parquet(f"{path}/in/{i}")
    frame = spark.createDataFrame(given, SCHEMA)
    stream = file_stream(spark, f"{path}/in/*", frame.schema, files_per_trigger=1)
    args = (stream, bounds) if bounds is not None else (stream,)
    return run_available(run(*args, **options), f"{path}/out")


def test_all_findings_equal_the_batch_scan(spark, tmp_path):
    given = rows()
    batch = spark.createDataFrame(given, SCHEMA).withColumn("date", F.to_date("ts")).drop("ts").withColumn("day_of_week", F.weekday("date"))
    bounds = anomaly.demand_bounds(batch)
    order = list(range(len(given)))
    order.sort(key=lambda j: (given[j][2], j % 2))
    rng = random.Random(1)
    for j in range(0, len(order) - 3, 3):  # out of order within the delay
        part = order[j : j + 3]
        rng.shuffle(part)
        order[j : j + 3] = part
    thirds = [order[:60], order[60:61], order[61:]]
    got = streamed(spark, str(tmp_path), given, bounds, thirds).collect()
    upto = max(r[2] for r in given).date() - timedelta(days=2)
    names = ["store_id", "product_id", "date", "sales", "anomaly_type", "anomaly_severity", "anomaly_score", "anomaly_reason"]
    want = [tuple(r) for r in anomaly.detect(batch).where(F.col("date") <= F.lit(upto)).select(*names).collect()]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    kinds = {(r.anomaly_type, r.anomaly_severity) for r in got}
    assert {t for t, _ in kinds} >= {"NORMAL", "MISSING_DATA", "DEMAND_DROP", "CRITICAL_DATA_ERROR", "DEMAND_SPIKE", "INVENTORY_JUMP", "PRICE_ANOMALY", "BUSINESS_EVENT"}


def test_idle_series_are_forgotten_after_their_time(spark, tmp_path):
    at = lambda d: datetime(2026, 1, 1) + timedelta(days=d)
    given = [("S", "P", at(d), 10.0 + d, 5.0, 1, 0) for d in (0, 1)]
    given += [("T", "P", at(d), 1.0, 5.0, 1, 0) for d in (20, 40, 41, 60, 80)] + [("S", "P", at(61), 99.0, 6.0, 2, 0)]
    files = [[0, 1], [2], [3, 4], [5], [7], [6]]
    kept = streamed(spark, str(tmp_path / "a"), given, None, files, run=measured).collect()
    gone = streamed(spark, str(tmp_path / "b"), given, None, files, run=measured, keep_days=30).collect()
    last = lambda found: next(r for r in found if r.store_id == "S" and r.sales == 99.0)
    assert (last(kept)._price_before, last(kept)._mean) == (5.0, pytest.approx((10 + 11 + 99) / 3))
    assert (last(gone)._price_before, last(gone)._mean) == (None, 99.0)
