"""Text inputs, runs over gaps, boosted champions, pages, grants and written tables."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast import session
from shelfcast.functions.skew import hot_keys
from shelfcast.operators import access, anomaly, clean, exchange, forecast, validate
from shelfcast.plans import flows
from shelfcast.plans.prepare import sales_panel

START = date(2026, 1, 1)


def text_rows(spark, form):
    rows = [((START + timedelta(days=i)).strftime(form), "S1", "A", str(5 + i % 4), "9.5", "n/a" if i % 2 else "0.1", "9" if i % 2 else "10") for i in range(40)]
    return spark.createDataFrame(rows, "date string, store_id string, product_id string, sales string, price string, Discount_Applied string, lead_time_days string")


def test_texts_give_the_panel_of_typed_columns(spark):
    text = text_rows(spark, "%m/%d/%Y")
    typed = text.select(
        F.to_date("date", "MM/dd/yyyy").alias("date"), "store_id", "product_id", F.col("sales").cast("double").alias("sales"), F.col("price").cast("double").alias("price"),
        F.col("Discount_Applied").try_cast("double").alias("Discount_Applied"), F.col("lead_time_days").cast("double").alias("lead_time_days"),
    )
    a, b = (sorted(map(str, sales_panel(x).collect())) for x in (text, typed))
    assert a == b and len(a) == 40
    twice = text.unionByName(text.withColumn("lead_time_days", F.lit("9")))
    assert {r.lead_time_days for r in clean.daily(twice).collect()} == {9.0, 10.0}


@pytest.mark.parametrize("form", ["%m/%d/%Y", "%Y/%m/%d", "%m-%d-%Y", "%Y%m%d", "%m/%d/%Y 13:05", "%Y-%m-%dT00:00:00"])
def test_date_formats(spark, form):
    df = text_rows(spark, form)
    assert {r.date for r in clean.daily(df).collect()} == {START + timedelta(days=i) for i in range(40)}


def test_no_readable_date_is_an_error(spark):
    df = text_rows(spark, "%m/%d/%Y").withColumn("date", F.lit("day one"))
    found = validate.validate(df, as_of=date(2027, 1, 1))
    assert validate.verdict(found).first().status == "FAIL"
    some = text_rows(spark, "%m/%d/%Y").withColumn("date", F.when(F.col("sales") == "5", "day one").otherwise(F.col("date")))
    assert validate.verdict(validate.validate(some, as_of=date(2027, 1, 1))).first().status == "WARNING"


def test_validation_scans_the_rows_three_times(spark, tmp_path):
    df = text_rows(spark, "%Y-%m-%d").withColumns({c: F.col(c).try_cast("double") for c in ("sales", "price")})
    df.write.parquet(f"{tmp_path}/raw")
    plan = validate.validate(spark.read.parquet(f"{tmp_path}/raw"), as_of=date(2027, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/raw") <= 3


def gappy(spark, n=80):
    rows = [(START + timedelta(days=i), "S1", "A", 20.0 + i % 3, 10.0) for i in range(n) if i % 4]
    rows += [(START + timedelta(days=i), "S1", "B", 30.0 + i % 5, 12.0) for i in range(n)]
    return spark.createDataFrame(rows, "date date, store_id string, product_id string, sales double, price double")


def test_days_without_rows_are_no_demand_drops(spark):
    run = flows.train(gappy(spark), as_of=date(2027, 1, 1), trees=0)
    assert run.flags.where("anomaly_type = 'DEMAND_DROP'").isEmpty()
    assert run.quality.first().data_quality_score == 100.0
    assert run.engineered.groupBy("product_id").count().where("count < 79").isEmpty()


def test_missing_sales_reach_the_scan(spark):
    df = gappy(spark).withColumn("sales", F.when((F.col("product_id") == "B") & (F.col("date") == date(2026, 2, 1)), None).otherwise(F.col("sales")))
    run = flows.train(df, as_of=date(2027, 1, 1), trees=0)
    found = run.flags.where("anomaly_type = 'MISSING_DATA'").collect()
    assert [(r.product_id, r.date) for r in found] == [("B", date(2026, 2, 1))]


def test_boosted_champions_are_served(spark):
    run = flows.train(gappy(spark), as_of=date(2027, 1, 1), trees=5)
    assert {frozenset(x.model_type for x in r.all_results) for r in run.champions.collect()} == {frozenset(forecast.CANDIDATES)}
    forced = run.champions.withColumn("model_type", F.lit("boosted_trees"))
    demand = flows.coming_demand(run.engineered, forced, pooled=run.pooled).collect()
    assert len(demand) == 14 and all(r.predicted_demand > 0 for r in demand if r.product_id == "B")
    served = flows.served_forecasts(run.engineered, forced, pooled=run.pooled)
    assert served.where("product_id = 'B' AND forecast = 0").isEmpty()


def test_pages_follow_the_whole_order(spark):
    r = random.Random(4)
    rows = sorted({(f"S{r.randint(1, 4)}", f"P{r.randint(1, 9)}", (START + timedelta(days=r.randint(0, 60))).isoformat()) for _ in range(400)})
    df = spark.createDataFrame(rows, "store_id string, product_id string, date string").withColumn("score", F.lit(1.0))
    for number, size in ((1, 50), (3, 50), (7, 13), (len(rows) // 50 + 1, 50), (999, 50)):
        got = [tuple(x)[:3] for x in anomaly.page(df, page=number, page_size=size).collect()]
        assert got == rows[(number - 1) * size : number * size]
    assert [tuple(x)[:3] for x in anomaly.page(df, page=2, page_size=7, store_id="S2").collect()] == [x for x in rows if x[0] == "S2"][7:14]


def test_fan_follows_the_share(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 800).alias("k"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fans = {r.k: r._fan for r in hot_keys(rows, ["k"], shares=100).collect()}
    assert fans == {-1: max(2, parts // 2)}


def test_grants_of_several_rows_add_up(spark):
    users = spark.createDataFrame([("u", "STAFF", "S1"), ("u", "STAFF", "S2, S3"), ("v", "STAFF", None)], "user string, role string, authorized_stores string")
    rows = spark.createDataFrame([(f"S{i}",) for i in range(1, 5)], "store_id string")
    assert sorted(r[0] for r in access.restrict(rows, users, "u").collect()) == ["S1", "S2", "S3"]
    assert access.restrict(rows, users, "v").isEmpty() and access.restrict(rows, users, "w").isEmpty()


def test_equal_requests_match_a_listing_once(spark):
    listings = spark.createDataFrame([("l1", "LISTED", 5)], "id string, status string, available_qty int")
    judged = spark.createDataFrame([("l1", "accepted"), ("l1", "accepted")], "listing_id string, outcome string")
    assert exchange.matched_listings(listings, judged).count() == 1


def test_tables_of_a_run_are_deleted(spark):
    with session.run_tables(spark):
        kept = session.materialise(spark.range(3), "gone")
        path = kept.inputFiles()[0].removeprefix("file:").replace("///", "/")
        assert os.path.exists(path) and kept.count() == 3
    assert not os.path.exists(path)
