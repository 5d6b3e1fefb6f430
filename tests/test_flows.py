from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from shelfcast.plans import flows


def raw(spark, n=60):
    start = date(2026, 1, 1)
    return spark.createDataFrame(
        [(str(start + timedelta(days=i)), s, p, float(5 + (i * k) % 7), 10.0 + k) for i in range(n) for k, (s, p) in enumerate([("S1", "A"), ("S1", "B"), ("S2", "A")], 1)],
        "Date string, Location string, Product_Name string, Quantity double, Unit_Price double",
    )


def test_training_run_leaves_all_tables(spark):
    run = flows.train(raw(spark), as_of=date(2027, 1, 1), scope="global", trees=3)
    assert run.verdict.first().status in ("PASS", "WARNING")
    assert run.engineered.count() == 2 * 2 * 60
    assert run.quality.first().total_records == 180  # the rows that exist
    assert run.champions.count() == 4


def test_training_stops_on_failed_validation(spark):
    with pytest.raises(ValueError):
        flows.train(raw(spark).withColumn("target", F.lit(1)), as_of=date(2027, 1, 1))


def test_health_of_series_with_and_without_model(spark):
    run = flows.train(raw(spark), as_of=date(2027, 1, 1), scope="global", trees=0)
    pairs = flows.served_forecasts(run.engineered, run.champions)
    models = run.champions.where("store_id = 'S1'").withColumn("registered_at", F.lit(datetime(2026, 5, 1)))
    got = {(r.store_id, r.product_id): r for r in flows.health_reports(run.engineered, pairs, models, run.quality).collect()}
    assert len(got) == 4
    missing = got[("S2", "A")]
    assert (missing.production_model, missing.model_status, missing.retraining_decision, missing.problem_products, missing.last_training_date) == (
        "None",
        "ARCHIVED/MISSING",
        "URGENT_RETRAIN",
        1,
        "Never",
    )
    assert missing.drift.total_features == 0 and missing.performance.degradation == 0.0
    assert got[("S1", "A")].drift.total_features > 20


def test_registry_of_queries_is_consistent():
    names, sqls = set(registry.queries()), set(registry.oracle_sql())
    assert sqls <= names and len(names) > 70
    own = {n for n in names - sqls if not (n.startswith("op") or n == "pipeline")}
    assert own == {"m03_boosted_trees", "m16_recursive_forecast", "m17_boosted_champions"}
