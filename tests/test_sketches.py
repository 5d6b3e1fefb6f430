"""Drift from merged sketches against the exact way, and rank errors of sketches that had to compress."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import monitor, sketches

START = date(2024, 1, 1)
FEATURES = ["x", "steps", "rare", "one", "never"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for k in range(3):
        for i in range(730):
            late = i >= 366
            data.append(
                (f"S{k}", "P", START + timedelta(days=i), float(rng.normal(10 + k * late, 2)), i * 7 % 5, float(i) if i % 50 == 0 else None,
                 float("nan") if i % 9 == 0 else 3.0, None)
            )
    schema = "store_id string, product_id string, date date, x double, steps int, rare double, one double, never double"
    return spark.createDataFrame(data, schema)


def discrete(values, p):
    """The smallest value with at least the share p of all at or below it."""
    v = np.sort(values)
    return v[max(int(np.ceil(p * len(v) - 1e-9)) - 1, 0)]


def plain_psi(reference, production):
    edges = sorted({discrete(reference, i / 10) for i in range(11)})
    if len(edges) < 2 or len(production) == 0:
        return 0.0
    r, p = (np.maximum(np.histogram(v, bins=edges)[0], 1) for v in (reference, production))
    r, p = r / r.sum(), p / p.sum()
    return float(((p - r) * np.log(p / r)).sum())


PERIODS = ((START, date(2024, 12, 31)), (date(2025, 1, 1), date(2025, 12, 30)))


def test_sketches_that_hold_all_values_give_exact_drift(spark, rows):
    kept = sketches.monthly(rows, FEATURES)
    assert kept.count() == 3 * (24 * 3 + len({(START + timedelta(days=i)).strftime("%Y%m") for i in range(0, 730, 50)}))
    got = {(r.store_id, r.feature): r.psi for r in sketches.drift(kept, *PERIODS).collect()}
    frame = rows.toPandas()
    for (store, feature), psi in got.items():
        own = frame[frame.store_id == store]
        values = own[feature].astype(float)
        sides = [values[(own.date >= lo) & (own.date <= hi)].dropna().to_numpy() for lo, hi in PERIODS]
        assert psi == pytest.approx(plain_psi(*sides), abs=1e-9), (store, feature)
    assert {f for _, f in got} == {"x", "steps", "rare", "one"} and len(got) == 12


def test_statuses_are_those_of_the_exact_way(spark, rows):
    """Interpolated edges differ a little; the drift found doesn't."""
    kept = sketches.monthly(rows, ["x"])
    sketched = {r.store_id: (r.psi, r.status) for r in sketches.drift(kept, *PERIODS).collect()}
    before, after = (rows.where(F.col("date").between(*p)) for p in PERIODS)
    for r in monitor.feature_drift(before, after, ["x"]).collect():
        assert sketched[r.store_id][0] == pytest.approx(r.psi, abs=0.05)
    assert [sketched[f"S{k}"][1] for k in range(3)] == ["LOW", "HIGH", "HIGH"]


def test_months_and_series_merge_to_any_period_and_level(spark, rows):
    kept = sketches.monthly(rows, ["x"])
    quarter = sketches.merged(kept, first=date(2024, 4, 2), last=date(2024, 6, 30))
    assert {r.n for r in quarter.collect()} == {91}  # whole months
    for by in (["store_id"], ["product_id"], []):
        level = sketches.merged(kept, by)
        assert sum(r.n for r in level.collect()) == 3 * 730
    new = sketches.monthly(rows.where("date >= '2025-12-01'"), ["x"])  # a later month joins the stored ones
    stored = sketches.monthly(rows.where("date < '2025-12-01'"), ["x"])
    a, b = (sketches.drift(s, *PERIODS).orderBy("store_id").collect() for s in (stored.union(new), kept))
    assert a == b


def test_ranks_of_compressed_sketches_are_within_the_stated_error(spark):
    n, size = 200_000, 64
    data = spark.range(n).selectExpr("cast(id * 7919 % 200003 as double) AS x", "date_add(date'2024-01-01', cast(id % 600 as int)) AS date", "'a' AS g")
    level = sketches.merged(sketches.monthly(data, ["x"], ["g"], size=size), [], size=size)
    probs = [i / 20 for i in range(1, 20)]
    found = level.select(sketches.quantiles("sketch", probs).alias("q")).first().q
    exact = np.sort(np.arange(n) * 7919 % 200003)
    error = np.abs(np.searchsorted(exact, found) / n - probs)
    assert error.max() <= 2 * sketches.rank_error(size) and sketches.rank_error(size) < 0.05


def test_empty_tables_and_periods(spark, rows):
    none = sketches.monthly(rows.limit(0), FEATURES)
    assert none.isEmpty() and sketches.drift(none, *PERIODS).isEmpty()
    kept = sketches.monthly(rows, ["x"])
    later = (date(2030, 1, 1), date(2030, 12, 31))
    assert {r.psi for r in sketches.drift(kept, PERIODS[0], later).collect()} == {0.0}
    assert sketches.drift(kept, later, PERIODS[0]).isEmpty()
