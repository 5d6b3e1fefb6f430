import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.operators import monitor, registry


def index_by_hand(expected, actual):
    edges = np.unique(np.percentile(expected, np.arange(0, 101, 10)))
    if len(edges) < 2 or not len(actual):
        return 0.0
    share = []
    for data in (expected, actual):
        counts = np.maximum(np.histogram(data, bins=edges)[0], 1)
        share.append(counts / counts.sum())
    return float(((share[1] - share[0]) * np.log(share[1] / share[0])).sum())


def sides(spark, expected, actual, schema="store_id string, product_id string, x double"):
    def make(values):
        return spark.createDataFrame([("S", "P", float(v)) for v in values], schema)

    return make(expected), make(actual)


grid = [i / 10 for i in range(100)]


@pytest.mark.parametrize(
    "expected, actual",
    [
        (grid, grid),
        (grid, [v + 5 for v in grid]),
        (grid, [v + 100 for v in grid]),
        ([1, 1, 1, 2, 2, 9], [1, 2, 3, 9, 9, 9, 0]),
        ([3, 3, 3], [3, 4]),
        ([0, 0, 0, 0, 0, 0, 0, 0, 0, 1], [1, 1, 0.5]),
    ],
)
def test_index_by_series_and_by_feature(spark, expected, actual):
    ref, prod = sides(spark, expected, actual)
    want = index_by_hand(expected, actual)
    for by in (["store_id", "product_id"], ["store_id"]):
        assert monitor.feature_drift(ref, prod, ["x", "absent"], by).first().psi == pytest.approx(want, abs=1e-12)


def test_levels(spark):
    same = monitor.feature_drift(*sides(spark, grid, grid), ["x"]).first()
    moved = monitor.feature_drift(*sides(spark, grid, [v + 5 for v in grid]), ["x"]).first()
    assert (same.status, moved.status) == ("LOW", "HIGH") and moved.psi > 0.25


def test_summary_names_the_first_of_the_strongest(spark):
    ref, prod = sides(spark, grid, [v + 5 for v in grid])
    wide = [f.withColumn("a", F.lit(1.0)).withColumn("y", F.col("x")) for f in (ref, prod)]
    r = monitor.drift_summary(monitor.feature_drift(*wide, ["a", "x", "y"])).first()
    assert (r.total_features, r.features_with_drift, r.percentage_drifted, r.highest_drift_feature) == (3, 2, 66.67, "x")
    calm = monitor.drift_summary(monitor.feature_drift(ref, ref, ["x"])).first()
    assert calm.highest_drift_feature == "None"


def performance(spark, pairs, ref):
    rows = spark.createDataFrame([("S", "P", float(a), float(f)) for a, f in pairs], "store_id string, product_id string, actual double, forecast double")
    held = spark.createDataFrame([("S", "P", ref)], "store_id string, product_id string, ref_wape double")
    return monitor.performance(rows, held).first()


def test_error_report(spark):
    good = performance(spark, [(100, 110), (200, 190), (300, 290)], 0.05)
    assert (good.mae, good.wape, good.status, good.degradation) == (10.0, 0.05, "HEALTHY", 0.0)
    bad = performance(spark, [(100, 50), (200, 100), (300, 150)], 0.02)
    assert bad.status == "PERFORMANCE_DEGRADATION"
    assert performance(spark, [(0, 3), (0, 1)], None).wape == 2.0


@pytest.mark.parametrize(
    "quality, status, drifted, want",
    [
        (95.0, "HEALTHY", 0, "NO_ACTION"),
        (95.0, "HEALTHY", 5, "MONITOR"),
        (95.0, "HIGH_BIAS", 0, "MONITOR"),
        (95.0, "HIGH_ERROR", 0, "RETRAIN"),
        (95.0, "PERFORMANCE_DEGRADATION", 0, "RETRAIN"),
        (95.0, "PERFORMANCE_DEGRADATION", 5, "URGENT_RETRAIN"),
        (60.0, "PERFORMANCE_DEGRADATION", 5, "INVESTIGATE"),
    ],
)
def test_decisions(spark, quality, status, drifted, want):
    choice = monitor.decision(F.lit(quality), F.lit(status), F.lit(10), F.lit(drifted))
    assert spark.range(1).select(choice.alias("d")).first().d == want


def test_promotion_of_candidates(spark):
    def ask(ref, cand):
        ref = F.lit(ref).cast("double")
        return spark.range(1).select(monitor.promote(ref, F.lit(cand)).alias("p")).first().p

    assert [ask(None, 5.0), ask(0.0, 5.0), ask(100.0, 98.0), ask(100.0, 98.5), ask(100.0, 120.0)] == [True, True, True, False, False]


def test_gate_needs_a_report(spark):
    reports = spark.createDataFrame([("S", "A", "RETRAIN"), ("S", "B", "MONITOR")], "store_id string, product_id string, retraining_decision string")
    asked = spark.createDataFrame([("S", p) for p in "ABC"], "store_id string, product_id string")
    got = {r.product_id: r.status for r in monitor.retrain_gate(asked, reports).collect()}
    assert got == {"A": "ACCEPTED", "B": "REJECTED", "C": "NOT_FOUND"}


# --- registry ---------------------------------------------------------------------------------


def registry_by_hand(events):
    """Events of one series in order: a live version and the archived ones, as a plain loop."""
    state, order, live = {}, {}, None
    for i, (event, version) in enumerate(events):
        if event == "REGISTER":
            if live is not None:
                state[live] = "ARCHIVED"
            state[version], order[version], live = "PRODUCTION", i, version
        elif live is not None:
            archived = [v for v, s in state.items() if s == "ARCHIVED"]
            if archived:
                state[live] = "ROLLED_BACK"
                live = max(archived, key=order.get)
                state[live] = "PRODUCTION"
    return state


def event_table(spark, series):
    start = datetime(2026, 1, 1)
    rows = [
        ("S", f"P{k}", f"v{i}", e, start + timedelta(hours=7 * i), i)
        for k, events in enumerate(series)
        for i, e in enumerate(events)
    ]
    return spark.createDataFrame(rows, "store_id string, product_id string, version_id string, event string, at timestamp, seq bigint")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["REGISTER", "ROLLBACK"]), min_size=1, max_size=25), min_size=1, max_size=12))
def test_versions_agree_with_a_plain_loop(spark, series):
    got = {}
    for r in registry.versions(event_table(spark, series)).collect():
        got.setdefault(r.product_id, {})[r.version_id] = r.status
    want = {f"P{k}": registry_by_hand([(e, f"v{i}") for i, e in enumerate(events)]) for k, events in enumerate(series)}
    assert got == {k: v for k, v in want.items() if v}


def test_rollback_is_an_event(spark):
    events = event_table(spark, [["REGISTER", "REGISTER"], ["REGISTER"]])
    wanted = spark.createDataFrame([("S", p, datetime(2027, 1, 1), 99) for p in ("P0", "P1")], "store_id string, product_id string, at timestamp, seq bigint")
    after = events.unionByName(registry.rollback(events, wanted))
    got = {(r.product_id, r.version_id): r.status for r in registry.versions(after).collect()}
    assert got == {("P0", "v0"): "PRODUCTION", ("P0", "v1"): "ROLLED_BACK", ("P1", "v0"): "PRODUCTION"}
    new = spark.createDataFrame([("S", "P0", "v9", datetime(2028, 1, 1), 100)], "store_id string, product_id string, version_id string, at timestamp, seq bigint")
    live = registry.production(after.unionByName(registry.register(after, new)))
    assert {(r.product_id, r.version_id) for r in live.collect()} == {("P0", "v9"), ("P1", "v0")}
