"""Versions in production at a time, against a pile that is kept event by event."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import monitor, registry

START = datetime(2026, 1, 1)
EVENTS = "store_id string, product_id string, version_id string, event string, at timestamp, seq long"


def plain(events, rows):
    """The top of each series' pile before every row; a rollback leaves the last version."""
    out = {}
    for s, p, at, seq, key in rows:
        pile = []
        for e in sorted((e for e in events if e[:2] == (s, p) and (e[4], e[5]) <= (at, seq)), key=lambda e: e[4:]):
            if e[3] == "REGISTER":
                pile.append(e[2])
            elif len(pile) > 1:
                pile.pop()
        out[key] = pile[-1] if pile else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_as_of_a_time(spark, seed):
    rng = random.Random(seed)
    events, rows = [], []
    for i in range(700):
        s = ("S1", "hot") if rng.random() < 0.5 else (f"S{rng.randrange(3)}", f"P{rng.randrange(4)}")
        at = START + timedelta(hours=rng.randrange(24 * 12))
        if rng.random() < 0.6:
            kind = "REGISTER" if rng.random() < 0.55 else "ROLLBACK"
            events.append((*s, f"v{i}" if kind == "REGISTER" else None, kind, at, i))
        else:
            rows.append((*s, at, i, i))
    rows += [("S9", "none", START, 1, 10_000), ("S1", "hot", START - timedelta(days=3), 1, 10_001), ("S1", "hot", START + timedelta(days=99), 1, 10_002)]
    frame = spark.createDataFrame(rows, "store_id string, product_id string, at timestamp, seq long, live_version long")
    log = spark.createDataFrame(events, EVENTS)
    got = registry.serving(frame, log).collect()
    assert {r.live_version: r.version_id for r in got} == plain(events, rows) and len(got) == len(rows)
    last = {(r.store_id, r.product_id): r.version_id for r in registry.production(log).collect()}
    ends = registry.serving(frame.where("live_version = 10002"), log).first()
    assert ends.version_id == last["S1", "hot"]


def test_errors_are_charged_to_the_version_that_served(spark):
    """v1, then v2, then back: errors of the middle days are v2's."""
    at = lambda d: START + timedelta(days=d)
    events = [("S", "P", "v1", "REGISTER", at(-5), 1), ("S", "P", "v2", "REGISTER", at(3), 2), ("S", "P", None, "ROLLBACK", at(6), 3)]
    pairs = [("S", "P", at(d), 100 + d, 10.0, 10.0 if not 3 <= d < 6 else 4.0) for d in range(9)]
    rows = spark.createDataFrame(pairs, "store_id string, product_id string, at timestamp, seq long, actual double, forecast double")
    charged = registry.serving(rows, spark.createDataFrame(events, EVENTS))
    found = {r.version_id: (r.wape, r.status) for r in monitor.performance(charged, by=["store_id", "product_id", "version_id"]).collect()}
    assert found == {"v1": (0.0, "HEALTHY"), "v2": (0.6, "HIGH_ERROR")}
    assert charged.groupBy("version_id").count().where("version_id = 'v2'").first()["count"] == 3


def test_nothing_registered_and_no_rows(spark):
    none = spark.createDataFrame([], EVENTS)
    rows = spark.createDataFrame([("S", "P", START, 1)], "store_id string, product_id string, at timestamp, seq long")
    assert registry.serving(rows, none).first().version_id is None
    assert registry.serving(rows.limit(0), none).isEmpty()
    back = spark.createDataFrame([("S", "P", None, "ROLLBACK", START, 0)], EVENTS)
    assert registry.serving(rows, back).first().version_id is None
    with pytest.raises(ValueError):
        registry.serving(rows.withColumn("version_id", F.lit("x")), none)
