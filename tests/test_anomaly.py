from datetime import date, timedelta

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfcast.operators import anomaly

SALES = [50, 52, 48, 51, 49, 53, 50, 48, 51, 50]


def frame(spark, sales=SALES, stock=None, promo=None, price=None):
    rows = [
        (date(2026, 8, 1) + timedelta(days=i), "PROD_1", "STORE_1", s, (promo or {}).get(i, 0), (stock or {}).get(i, 100), (price or {}).get(i, 10.0))
        for i, s in enumerate(sales)
    ]
    return spark.createDataFrame(
        rows, "date date, product_id string, store_id string, sales bigint, is_promotion int, current_stock bigint, price double"
    )


def flags(df, rules=anomaly.AnomalyRules()):
    return anomaly.detect(df, rules).orderBy("date").collect()


def test_clean_series_scores_100(spark):
    found = anomaly.detect(frame(spark))
    q = anomaly.quality(found).first()
    assert (q.total_records, q.anomalies, q.data_quality_score, q.status) == (10, 0, 100.0, "HEALTHY")


def test_spike(spark):
    last = flags(frame(spark, SALES[:9] + [500]))[9]
    assert (last.anomaly_type, last.anomaly_severity, last.anomaly_score) == ("DEMAND_SPIKE", "HIGH", 1.0)


def test_promotion_explains_a_spike(spark):
    rules = anomaly.AnomalyRules(promo_threshold_multiplier=5.0)
    last = flags(frame(spark, SALES[:9] + [400], promo={9: 1}), rules)[9]
    assert (last.anomaly_type, last.anomaly_severity) == ("BUSINESS_EVENT", "LOW")


def test_negative_stock_is_critical(spark):
    found = anomaly.detect(frame(spark, stock={5: -50}))
    row = found.where("current_stock < 0").first()
    assert (row.anomaly_type, row.anomaly_severity) == ("CRITICAL_DATA_ERROR", "CRITICAL")
    q = anomaly.quality(found).first()
    assert q.critical == 1 and q.data_quality_score < 100 and q.status == "WARNING"


def test_missing_sales_end_the_scan_of_a_row(spark):
    row = flags(frame(spark, SALES[:5] + [None] + SALES[6:], stock={5: -1}))[5]
    assert row.anomaly_type == "MISSING_DATA"


def test_empty_table_is_an_error(spark):
    q = anomaly.quality(anomaly.detect(frame(spark).limit(0))).first()
    assert (q.status, q.data_quality_score, q.total_records) == ("ERROR", 0.0, 0)


def test_default_store(spark):
    assert anomaly.detect(frame(spark).drop("store_id")).first().store_id == "DEFAULT_STORE"


def test_page_bounds(spark):
    records = anomaly.records(anomaly.detect(frame(spark, stock={i: -1 for i in range(10)})))
    assert [r.date for r in anomaly.page(records, page=2, page_size=4).collect()] == ["2026-08-05", "2026-08-06", "2026-08-07", "2026-08-08"]
    assert anomaly.page_totals(records, page_size=4).first().total_pages == 3
    with pytest.raises(ValueError):
        anomaly.page(records, page_size=101)


RANK = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def by_hand(rows):
    """One series row by row: a strictly higher severity replaces, missing and drops end the row."""
    s = pd.Series([r["sales"] for r in rows], dtype="float64")
    upper = s.quantile(0.75) + 1.5 * (s.quantile(0.75) - s.quantile(0.25))
    mean = s.rolling(7, min_periods=1).mean()
    out = []
    for i, r in enumerate(rows):
        hits = []
        v, bound = r["sales"], upper * (2.0 if r["promo"] else 1.0)
        if v is None:
            out.append("MISSING_DATA")
            continue
        if v == 0 and mean[i] > 10:
            out.append("DEMAND_DROP")
            continue
        if v > bound:
            ratio = min(1.0, v / (bound + 1e-5))
            hits.append(("BUSINESS_EVENT", "LOW") if r["promo"] else ("DEMAND_SPIKE", "HIGH" if ratio > 0.9 else "MEDIUM"))
        if r["stock"] < 0:
            hits.append(("CRITICAL_DATA_ERROR", "CRITICAL"))
        elif i and r["stock"] > rows[i - 1]["stock"] + 1000:
            hits.append(("INVENTORY_JUMP", "HIGH"))
        if r["price"] <= 0:
            hits.append(("CRITICAL_DATA_ERROR", "CRITICAL"))
        elif i and rows[i - 1]["price"] > 0 and not 0.2 <= r["price"] / rows[i - 1]["price"] <= 2.0:
            hits.append(("PRICE_ANOMALY", "HIGH"))
        best = ("NORMAL", "NONE")
        for h in hits:
            if RANK[h[1]] > RANK[best[1]]:
                best = h
        out.append(best[0])
    return out


ROW = st.fixed_dictionaries(
    {
        "sales": st.one_of(st.none(), st.integers(0, 20), st.integers(0, 400)),
        "promo": st.integers(0, 1),
        "stock": st.sampled_from([-1, 0, 50, 1200, 3000]),
        "price": st.sampled_from([0.0, 1.0, 2.5, 9.0]),
    }
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, min_size=2, max_size=25))
def test_rules_agree_with_a_plain_loop(spark, rows):
    df = frame(
        spark,
        [r["sales"] for r in rows],
        {i: r["stock"] for i, r in enumerate(rows)},
        {i: r["promo"] for i, r in enumerate(rows)},
        {i: r["price"] for i, r in enumerate(rows)},
    )
    assert [r.anomaly_type for r in flags(df)] == by_hand(rows)
