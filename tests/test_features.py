from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import features


def frame(spark, products=("P1",), n=30):
    start = date(2026, 1, 1)
    rows = [
        (start + timedelta(days=i), p, "S1", float(i + (1 if p == "P1" else 100)), 10.0, int(i >= 15))
        for p in products
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "date date, product_id string, store_id string, sales double, price double, promotion int")


def test_lags_stay_within_a_series(spark):
    rows = features.lag_features(frame(spark, ("P1", "P2"))).orderBy("product_id", "date").collect()
    assert (rows[0].lag_1, rows[0].has_lag_1, rows[1].lag_1, rows[1].has_lag_1) == (None, 0, 1.0, 1)
    assert (rows[30].lag_1, rows[31].lag_1) == (None, 100.0)


def test_a_zero_sale_is_history(spark):
    df = frame(spark).withColumn("sales", F.lit(0.0))
    row = features.lag_features(df).orderBy("date").collect()[1]
    assert (row.lag_1, row.has_lag_1) == (0.0, 1)


def test_rolling_means_leave_out_the_day(spark):
    rows = features.rolling_features(frame(spark)).orderBy("date").collect()
    assert [rows[i].rolling_mean_7 for i in (0, 1, 2, 7)] == [None, 1.0, 1.5, 4.0]
    assert rows[1].rolling_std_7 is None


def test_no_feature_looks_at_the_day_or_later(spark):
    df = frame(spark)
    changed = df.withColumn("sales", F.when(F.col("date") >= date(2026, 1, 20), F.lit(999.0)).otherwise(F.col("sales")))
    names = [c for c in features.engineer(df).columns if c.startswith(("lag_", "rolling_", "trend_"))]
    upto = F.col("date") <= date(2026, 1, 20)
    a = features.engineer(df).where(upto).orderBy("date").select(*names).collect()
    b = features.engineer(changed).where(upto).orderBy("date").select(*names).collect()
    assert a == b


def test_optional_columns_may_be_absent(spark):
    out = features.engineer(frame(spark).drop("promotion", "price"))
    assert "is_promotion" not in out.columns and "price_change" not in out.columns and out.count() == 30


def test_split_is_chronological(spark):
    split = features.chronological_split(frame(spark))
    rows = {r.split: r for r in split.groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    assert (rows["train"].n, rows["validation"].n, rows["test"].n) == (21, 4, 5)
    assert rows["train"].b < rows["validation"].a and rows["validation"].b < rows["test"].a


@pytest.mark.parametrize("n", [1, 7, 30, 100])
def test_split_sizes_follow_the_shares(spark, n):
    got = {r.split: r["count"] for r in features.chronological_split(frame(spark, n=n)).groupBy("split").count().collect()}
    first, second = int(n * 0.7), int(n * 0.85)
    want = {"train": first, "validation": second - first, "test": n - second}
    assert got == {k: v for k, v in want.items() if v}


def test_numeric_features_leave_out_keys_and_booleans(spark):
    out = features.one_hot(features.engineer(frame(spark)), {"store_id": ["S1"]})
    names = features.numeric_features(out)
    assert "lag_1" in names and "price_change" in names
    assert not {"sales", "price", "store_id", "store_id_S1"} & set(names)


def test_report_counts(spark):
    before = frame(spark)
    r = features.feature_report(before, features.engineer(before)).first()
    assert (r.lag, r.history_flags, r.rolling, r.calendar, r.trend, r.promotion, r.price) == (4, 4, 9, 11, 1, 1, 3)
