"""The additive model against numpy's least squares, stored sums against one fit, and its error against the line with means."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import additive, forecast

START = date(2024, 1, 1)


def frame(spark, series, parts=3):
    rows = [
        (f"S{k}", f"P{k}", START + timedelta(days=lag + i * step), None if i % 11 == 7 else float(value(i)), int(promoted and i % 5 == 0))
        for k, (n, step, lag, promoted, value) in enumerate(series)
        for i in range(n)
    ]
    schema = "store_id string, product_id string, date date, sales double, is_promotion int"
    return spark.createDataFrame(rows, schema).repartition(parts, "date")  # a series lies in many tasks


SERIES = [
    (800, 1, 0, True, lambda i: 20 + 0.02 * i + 5 * np.sin(2 * np.pi * i / 7) + 8 * np.cos(2 * np.pi * i / 365.25) + 3 * (i % 5 == 0)),
    (300, 2, 100, False, lambda i: 50 - 0.1 * i + (i * 37) % 11),
    (60, 1, 700, True, lambda i: (i * 13) % 7),
    (10, 1, 790, True, lambda i: 5 + i),
    (1, 1, 0, False, lambda i: 4),
]


def design(rows, first, last):
    """The terms in numpy."""
    d = np.array([(r.date - first).days for r in rows], float)
    u = d / (last - first).days
    dow = np.array([r.date.weekday() for r in rows], float)
    doy = np.array([r.date.timetuple().tm_yday for r in rows], float)
    cols = [np.ones(len(rows)), u] + [np.maximum(u - 0.8 * k / 7, 0) for k in range(1, 7)]
    for waves, x, length in ((3, dow, 7), (4, doy, 365.25)):
        for j in range(1, waves + 1):
            cols += [np.sin(2 * np.pi * j * x / length), np.cos(2 * np.pi * j * x / length)]
    return np.stack([*cols, [float(r.is_promotion) for r in rows]], 1)


def by_numpy(rows, first, last):
    """Ridge regression as least squares over rows that stand for the penalties."""
    rows = [r for r in rows if r.sales is not None]
    x, y = design(rows, first, last), np.array([r.sales for r in rows])
    span = (max(r.date for r in rows) - min(r.date for r in rows)).days
    keep = np.ones(23, bool)
    keep[8:14], keep[14:22] = span > 14, span > 365
    keep[22] = len({r.is_promotion for r in rows}) > 1
    x[:, ~keep] = 0
    penalty = np.array([0, 0.01] + [0.02] * 6 + [0.05] * 14 + [0.001])
    extra = np.diag(np.sqrt(penalty * len(rows)))
    b, *_ = np.linalg.lstsq(np.vstack((x, extra)), np.concatenate((y, np.zeros(23))), rcond=None)
    return b, np.maximum(design(rows, first, last)[:, keep] @ b[keep], 0)


def test_coefficients_are_those_of_least_squares(spark):
    learnt = frame(spark, SERIES)
    fitted = additive.fit(learnt, F.col("is_promotion")).collect()
    by_series = {}
    for r in learnt.orderBy("date").collect():
        by_series.setdefault(r.store_id, []).append(r)
    first, last = min(r.date for v in by_series.values() for r in v), max(r.date for v in by_series.values() for r in v)
    assert len(fitted) == len(by_series)
    for f in fitted:
        want, _ = by_numpy(by_series[f.store_id], first, last)
        assert (f.first, f.last) == (first, last)
        assert np.allclose(f.additive, want, atol=1e-8), f.store_id


def test_forecasts_are_the_terms_times_the_coefficients(spark):
    learnt = frame(spark, SERIES[:2])
    out = learnt.join(additive.fit(learnt, F.col("is_promotion")), ["store_id", "product_id"])
    got = {(r.store_id, r.date): r.v for r in out.withColumn("v", additive.additive(F.col("is_promotion"))).collect()}
    for store in ("S0", "S1"):
        rows = [r for r in learnt.orderBy("date").collect() if r.store_id == store and r.sales is not None]
        _, want = by_numpy(rows, START, max(r.date for r in learnt.collect()))
        assert np.allclose([got[store, r.date] for r in rows], want, atol=1e-8)


def test_stored_sums_take_in_new_days(spark):
    rows = frame(spark, SERIES)
    first, last, promo = F.lit(START), F.lit(START + timedelta(days=799)), F.col("is_promotion")
    cut = START + timedelta(days=600)
    old, new = (additive.systems(rows.where(w), promo, first, last) for w in (F.col("date") < cut, F.col("date") >= cut))
    whole = {r.store_id: r.additive for r in additive.coefficients(additive.systems(rows, promo, first, last)).collect()}
    merged = {r.store_id: r.additive for r in additive.coefficients(old.union(new)).collect()}
    assert whole.keys() == merged.keys() and all(np.allclose(whole[k], merged[k], atol=1e-7) for k in whole)


def test_more_series_than_a_task_holds(spark, monkeypatch):
    rows = frame(spark, [(9, 1, 0, True, lambda i, k=k: i + k) for k in range(7)], parts=1)
    args = (F.col("is_promotion"), F.lit(START), F.lit(START + timedelta(days=9)))
    want = {r.store_id: r.additive for r in additive.coefficients(additive.systems(rows, *args)).collect()}
    import pyarrow as pa

    monkeypatch.setattr(additive, "HELD_SERIES", 2)
    batch = rows.where("sales IS NOT NULL").select(
        "store_id", "product_id", F.unix_date("date").cast("bigint").alias("day"), F.col("sales").alias("y"), F.array(*additive.terms("date", *args)).alias("terms")
    ).toArrow().combine_chunks().to_batches()
    parts = pa.Table.from_batches(list(additive._sum_systems(iter(batch)))).to_pandas()
    assert len(parts) == 7
    got = {k: additive._solve_series(g).additive[0] for (k,), g in parts.groupby(["store_id"])}
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_sparse_null_and_empty_series(spark):
    none = frame(spark, [(1, 1, 0, False, lambda i: 1)]).limit(0)
    assert additive.fit(none, F.col("is_promotion")).isEmpty()
    one = frame(spark, [(1, 1, 0, False, lambda i: 4)])
    fitted = additive.fit(one, F.col("is_promotion"))
    value = one.join(fitted, ["store_id", "product_id"]).select(additive.additive(F.col("is_promotion")).alias("v")).first().v
    assert value == pytest.approx(4.0)


def test_joint_fit_errs_less_than_parts_taken_one_after_another(spark):
    def value(i):  # a trend that bends, a year that runs with it, promotions on some weekdays
        return 30 + (0.05 * i if i < 400 else 20 - 0.03 * (i - 400)) + 10 * np.sin(2 * np.pi * i / 365.25) + 4 * (i % 7 == 2)

    rows = frame(spark, [(900, 1, 0, True, value)]).withColumn("learn", F.col("date") < START + timedelta(days=760)).fillna(0.0)
    out = forecast.add_candidates(rows)
    e = out.agg(*[F.sum(F.abs(F.col("sales") - F.col(c))).alias(c) for c in (forecast.ADDITIVE, forecast.TREND)]).first()
    assert e[forecast.ADDITIVE] < e[forecast.TREND]
