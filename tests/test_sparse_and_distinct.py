"""Range frames against the dense panel, the rollup against single aggregates, distinct sketches against sets, and the scan of missing sales."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import anomaly, clean, distinct, features
from shelfcast.plans import flows
from shelfcast.plans.prepare import prepared

START = date(2026, 1, 1)


def sparse(spark, seed, n=80):
    rng = random.Random(seed)
    rows = [
        (f"S{k % 2}", f"P{k}", START + timedelta(days=i), float(rng.choice([0, 3, 7.5, 40, -2])), 10.0, 0)
        for k, share in enumerate((0.1, 0.5, 0.9, 1.0, 0.03))
        for i in range(n)
        if rng.random() < share
    ]
    return spark.createDataFrame(rows, "store_id string, product_id string, date date, sales double, price double, promotion int")


@pytest.mark.parametrize("seed,scope", [(1, "observed"), (2, "global"), (3, "observed")])
def test_range_frames_equal_windows_over_the_dense_panel(spark, seed, scope):
    days = sparse(spark, seed)
    first = None if scope == "observed" else days.agg(F.min("date")).scalar()
    got = features.sparse_history(days, first=first)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and got.count() == days.count()
    dense = features.trend_features(features.rolling_features(features.lag_features(clean.densify(days, scope=scope))))
    want = {(r.store_id, r.product_id, r.date): r for r in dense.collect()}
    names = [c for c in got.columns if c not in days.columns]
    assert set(names) == set(dense.columns) - set(clean.densify(days, scope=scope).columns)
    for r in got.collect():
        w = want[r.store_id, r.product_id, r.date]
        for c in names:
            assert (r[c] is None) == (w[c] is None), (c, r, w)
            assert r[c] is None or r[c] == pytest.approx(w[c], abs=1e-9), c


def test_null_sales_and_empty_tables_of_sparse_history(spark):
    days = sparse(spark, 1).withColumn("sales", F.when(F.col("store_id") == "S0", F.col("sales")))
    zero = {(r.product_id, r.date): r.rolling_mean_7 for r in features.sparse_history(days.fillna(0.0, ["sales"])).collect()}
    assert {(r.product_id, r.date): r.rolling_mean_7 for r in features.sparse_history(days).collect()} == zero
    assert features.sparse_history(days.limit(0)).isEmpty()


def test_all_levels_of_quality_equal_their_single_aggregates(spark):
    flags = anomaly.detect(features.promotion_features(features.calendar_features(sparse(spark, 5))))
    levels = anomaly.quality_levels(flags)
    for level, by in (("series", ["store_id", "product_id"]), ("store", ["store_id"]), ("all", [])):
        single = anomaly.quality(flags, by)
        own = levels.where(F.col("level") == level).select(*single.columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, single.collect()))
    assert anomaly.quality_levels(flags.limit(0)).isEmpty()


def test_distinct_sketches_of_any_range(spark):
    rng = random.Random(9)
    data = [(START + timedelta(days=rng.randrange(30)), f"S{rng.randrange(4)}", rng.choice([None, f"P{rng.randrange(3000)}"])) for _ in range(20_000)]
    rows = spark.createDataFrame(data, "date date, store_id string, product_id string")
    kept = distinct.daily_sketches(rows, {"products": "product_id", "series": ["store_id", "product_id"]}, by=["store_id"])
    assert kept.count() <= 30 * 4
    for lo, hi in ((0, 29), (3, 3), (10, 19)):
        a, b = START + timedelta(days=lo), START + timedelta(days=hi)
        inside = [(s, p) for d, s, p in data if a <= d <= b]
        r = distinct.distinct_between(kept, ["products", "series"], first=a, last=b).first()
        assert r.rows == len(inside)
        for name, want in (("products", {p for _, p in inside if p}), ("series", {(s, p) for s, p in inside if p})):
            assert abs(r[name] - len(want)) <= max(1, distinct.relative_error() * len(want))
    per = {r.store_id: r.products for r in distinct.distinct_between(kept, ["products"], by=["store_id"]).collect()}
    assert set(per) == {"S0", "S1", "S2", "S3"}
    # The same rows again change nothing but their number.
    twice = distinct.daily_sketches(rows.union(rows), {"products": "product_id"})
    once = distinct.daily_sketches(rows, {"products": "product_id"})
    a, b = (distinct.distinct_between(s, ["products"]).first() for s in (twice, once))
    assert (a.products, a.rows) == (b.products, 2 * b.rows)
    none = distinct.distinct_between(kept, ["products"], first=date(2030, 1, 1)).first()
    assert (none.rows, none.products) == (0, 0)


def test_missing_sales_do_not_lift_the_fence_of_a_training_run(spark):
    """Sales of 20 to 23 with every third day missing: the fence is that of the known days, and 30 stands out."""
    rows = [(str(START + timedelta(days=i)), "S", "P", None if i % 3 == 2 else (30.0 if i == 57 else float(20 + i % 4)), 5.0) for i in range(60)]
    raw = spark.createDataFrame(rows, "date string, store_id string, product_id string, sales double, price double")
    days, panel = prepared(raw)
    seen = features.promotion_features(features.calendar_features(days))
    fence = anomaly.demand_bounds(seen).first().base_upper
    q1, q3 = np.percentile([r[3] for r in rows if r[3] is not None], [25, 75])
    assert fence == pytest.approx(q3 + 1.5 * (q3 - q1)) and fence < 30
    found = {(r.date, r.anomaly_type) for r in anomaly.detect(seen).where("is_anomaly").collect()}
    missing = {START + timedelta(days=i) for i in range(60) if i % 3 == 2}
    assert {d for d, t in found if t == "MISSING_DATA"} == missing
    assert (START + timedelta(days=57), "DEMAND_SPIKE") in found
    assert panel.where("sales IS NULL").isEmpty() and panel.count() == 60
    run = flows.train(raw, as_of=date(2027, 1, 1), trees=0, min_history=10)
    assert {(r.date, r.anomaly_type) for r in run.flags.where("is_anomaly").collect()} == found
