"""Days added one by one against the full build."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import clean, features
from shelfcast.plans.increments import KEPT_DAYS, PanelState

START = date(2026, 1, 1)
SCHEMA = "store_id string, product_id string, date date, sales double, price double, promotion int, safety_stock int, lead_time_days int"


def observed(seed=4, n=70):
    """Series with gaps, a new one, one that ends, one with a single day."""
    rng = random.Random(seed)
    rows = []
    for k in range(6):
        for i in range(n):
            alive = {3: i >= n - 6, 4: i < n - 20, 5: i == n - 3}.get(k, True)
            if alive and rng.random() < (0.25 if k == 1 else 0.8):
                rows.append((f"S{k % 2}", f"P{k}", START + timedelta(days=i), float(rng.randrange(40)), 10.0 + rng.randrange(5), int(rng.random() < 0.2), 20, 2))
    return rows


def comparable(rows):
    names = sorted(rows.columns)
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in rows.collect()) if names else []


def key(r):
    return tuple(str(x) for x in r)


def full(spark, rows):
    return features.engineer(clean.densify(spark.createDataFrame(rows, SCHEMA)))


def sorted_rows(df):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in df.collect()), key=key)


@pytest.mark.parametrize("step", [1, 4])
def test_ten_days_added_equal_the_full_build(spark, step):
    rows = observed()
    cut = START + timedelta(days=60)
    old = [r for r in rows if r[2] < cut]
    state = PanelState.start(clean.densify(spark.createDataFrame(old, SCHEMA)))
    known = {(r.store_id, r.product_id): r.last_date for r in state.read().collect()}
    got = []
    for d in range(0, 10, step):
        lo, hi = cut + timedelta(days=d), cut + timedelta(days=d + step)
        days = spark.createDataFrame([r for r in rows if lo <= r[2] < hi], SCHEMA)
        got += sorted_rows(state.rows(days))
        following = state.after(days)
        state.drop()
        state = following
    whole = full(spark, rows)
    want = [r for r in whole.collect() if known.get((r.store_id, r.product_id)) is None or r.date > known[r.store_id, r.product_id]]
    names = sorted(whole.columns)
    want = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in want), key=key)
    assert sorted(got, key=key) == want and want
    ends = whole.groupBy("store_id", "product_id").agg(F.max("date").alias("last_date"), F.count(F.lit(1)).alias("days"), F.sum("sales").alias("total"))
    assert sorted_rows(state.read().drop("recent")) == sorted_rows(ends)
    assert state.read().where(F.size("recent") > KEPT_DAYS).isEmpty()
    state.drop()


def test_the_state_is_never_shuffled(spark):
    rows = observed()
    state = PanelState.start(clean.densify(spark.createDataFrame([r for r in rows if r[2].month == 1], SCHEMA)))
    days = spark.createDataFrame([r for r in rows if r[2].month == 2], SCHEMA)
    made = state.rows(days)
    assert shuffled_under(made, state.name) == 0 and made.count() > 0
    grown = state._grown(days)
    assert shuffled_under(grown, state.name) == 0
    state.drop()


def shuffled_under(df, table):
    """How many scans of ``table`` lie under an exchange in the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in lines]
    found = 0
    for i, line in enumerate(lines):
        if "Exchange" in line:
            j = i + 1
            while j < len(lines) and depth[j] > depth[i]:
                found += table in lines[j]
                j += 1
    return found


def test_late_days_repeats_and_an_empty_start(spark):
    rows = observed()
    none = spark.createDataFrame([], SCHEMA)
    state = PanelState.start(clean.densify(none))
    first = spark.createDataFrame([r for r in rows if r[2].month == 1], SCHEMA)
    assert sorted_rows(state.rows(first)) == sorted_rows(full(spark, [r for r in rows if r[2].month == 1]))
    following = state.after(first)
    assert following.rows(first).isEmpty()  # the same days again add nothing
    again = following.after(first)
    assert sorted_rows(again.read()) == sorted_rows(following.read())
    assert following.rows(none).isEmpty()
    for s in (state, following, again):
        s.drop()
