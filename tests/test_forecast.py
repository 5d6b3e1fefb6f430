from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import boosted, features, forecast, selection
from shelfcast.plans import flows

START = date(2026, 1, 1)


def frame(spark, n=100, step=1, product="P1", value=lambda i: 10 + (i * 37) % 40):
    rows = [(START + timedelta(days=i * step), product, "S1", float(value(i)), 10.0, int(i % 5 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "date date, product_id string, store_id string, sales double, price double, promotion int")


def learnt_and_rest(spark, n=100, **options):
    df = features.chronological_split(features.promotion_features(frame(spark, n, **options)))
    return df.where("split = 'train'"), df.where("split = 'validation'")


def test_naive_is_the_last_learnt_value(spark):
    train, val = learnt_and_rest(spark)
    out = forecast.predict(val, forecast.fit(train)).orderBy("date").collect()
    last = train.orderBy(F.desc("date")).first().sales
    assert len(out) == val.count() and {r.baseline_naive for r in out} == {last}


def test_no_forecast_is_negative(spark):
    train, val = learnt_and_rest(spark, value=lambda i: 100 - i)
    out = forecast.predict(val, forecast.fit(train)).collect()
    assert all(r[c] >= 0 for r in out for c in (forecast.NAIVE, forecast.SEASONAL_NAIVE, forecast.TREND))


@pytest.mark.parametrize("step", [1, 7, 3])
def test_seasonal_naive_uses_the_last_seven_rows(spark, step):
    train, val = learnt_and_rest(spark, step=step)
    rows = train.orderBy("date").collect()[-7:]
    known = {r.date.weekday(): r.sales for r in rows}
    out = forecast.predict(val, forecast.fit(train)).collect()
    assert all(r[forecast.SEASONAL_NAIVE] == known.get(r.date.weekday(), rows[-1].sales) for r in out)


def test_cycled_naive_repeats_what_there_is(spark):
    fitted = forecast.fit(frame(spark, 5))
    out = forecast.future_rows(fitted, 7).orderBy("step").select(forecast.cycled_naive(F.col("step")).alias("v")).collect()
    values = [r.sales for r in frame(spark, 5).orderBy("date").collect()]
    assert [r.v for r in out] == [values[i % 5] for i in range(7)]


def by_hand(train, val):
    """Trend and mean residuals step by step in pandas."""
    t = train.copy()
    x = (pd.to_datetime(t.date) - pd.Timestamp(START)).dt.days
    slope, intercept = np.polyfit(x, t.sales, 1)
    days = (pd.to_datetime(t.date).max() - pd.to_datetime(t.date).min()).days
    t["rest"] = t.sales - intercept - slope * x
    xv = (pd.to_datetime(val.date) - pd.Timestamp(START)).dt.days
    fit = intercept + slope * xv
    for name, on, gate in (("dow", lambda d: d.dt.weekday, days > 14), ("month", lambda d: d.dt.month, days > 365), ("promo", None, True)):
        key, kv = (t.is_promotion, val.is_promotion) if on is None else (on(pd.to_datetime(t.date)), on(pd.to_datetime(val.date)))
        if gate and (name != "promo" or t.is_promotion.nunique() > 1):
            means = t.rest.groupby(key).mean()
            t["rest"] = t.rest - key.map(means)
            fit = fit + kv.map(means).fillna(0).values
    return np.maximum(fit, 0)


@pytest.mark.parametrize("n", [12, 100, 700])
def test_trend_equals_the_same_steps_in_pandas(spark, n):
    train, val = learnt_and_rest(spark, n)
    out = forecast.predict(val, forecast.fit(train)).orderBy("date").toPandas()
    want = by_hand(train.orderBy("date").toPandas(), val.orderBy("date").toPandas())
    assert np.allclose(out[forecast.TREND].values, want)


def test_short_or_empty_series_get_the_naive_model_only(spark):
    few = forecast.add_candidates(frame(spark, 6).withColumn("learn", F.col("date") < START + timedelta(days=4)))
    none_sold = forecast.add_candidates(frame(spark, 20, value=lambda i: 0).withColumn("learn", F.col("date") < START + timedelta(days=15)))
    for rows in (few, none_sold):
        assert {r.model_type for r in selection.score_candidates(rows).collect()} == {forecast.NAIVE}


def test_metrics(spark):
    long = spark.createDataFrame(
        [("S", "P", "m", 0.0, 1.0), ("S", "P", "m", 10.0, 8.0), ("S", "P", "m", 20.0, 25.0)],
        "store_id string, product_id string, model_type string, y double, yhat double",
    )
    r = selection.score(long).first()
    assert (r.mae, r.rmse, r.mape, r.wape, r.reliability, r.n) == (2.67, 3.16, 22.5, 26.67, "Moderate", 3)


def scores(spark, **wapes):
    rows = [("S", "P", m, w / 10, w / 10, w, w, 5, "Low") for m, w in wapes.items()]
    return spark.createDataFrame(
        rows,
        "store_id string, product_id string, model_type string, mae double, rmse double, mape double, wape double, n bigint, reliability string",
    )


def champion(spark, current, **wapes):
    held = None if current is None else spark.createDataFrame([("S", "P", *current)], "store_id string, product_id string, model_type string, version bigint")
    r = selection.select_champions(scores(spark, **wapes), held).first()
    return r.model_type, r.version, r.kept_champion


def test_champion_rules(spark):
    N, S, T = forecast.NAIVE, forecast.SEASONAL_NAIVE, forecast.TREND
    assert champion(spark, None, **{N: 30.0, T: 20.0}) == (T, 1, False)
    assert champion(spark, (N, 3), **{N: 30.0, T: 29.9}) == (N, 4, True)
    assert champion(spark, (N, 3), **{N: 30.0, T: 20.0}) == (T, 1, False)
    assert champion(spark, (T, 2), **{N: 30.0, T: 20.0}) == (T, 3, False)
    assert champion(spark, ("gone", 2), **{N: 30.0, T: 29.9}) == (T, 1, False)
    assert champion(spark, (N, 1), **{N: 0.0, T: 0.0}) == (N, 2, True) or champion(spark, (N, 1), **{N: 0.0, T: 0.0}) == (T, 1, False)
    assert champion(spark, None, **{N: 20.0, S: 20.0, T: 20.0})[0] == T


def test_selection_again_on_the_same_data_keeps_the_champion(spark):
    panel = frame(spark)
    first = flows.choose_models(panel)
    again = flows.choose_models(panel, first.select("store_id", "product_id", "model_type", "version"))
    a, b = first.first(), again.first()
    assert (a.model_type, b.model_type, b.version) == (a.model_type, a.model_type, a.version + 1)


def test_coming_days_follow_the_last_date_and_need_a_champion(spark):
    panel = frame(spark).unionByName(frame(spark, product="P2"))
    chosen = flows.choose_models(frame(spark))
    out = flows.coming_demand(panel, chosen, 3).orderBy("date").collect()
    assert [r.date for r in out] == [START + timedelta(days=100 + i) for i in range(3)]
    assert {r.product_id for r in out} == {"P1"} and all(r.predicted_demand >= 0 for r in out)


def test_boosted_trees_and_recursion(spark):
    engineered = features.engineer(frame(spark, value=lambda i: 20 if i % 7 in (5, 6) else 5))
    names = features.numeric_features(engineered)
    model, used = boosted.train_boosted(engineered, names, trees=5, depth=3)
    out = boosted.forecast_recursive(model, used, engineered, horizon=7).orderBy("step").collect()
    assert [r.step for r in out] == list(range(1, 8))
    assert [r.date for r in out] == [START + timedelta(days=100 + i) for i in range(7)]
    # Day n's lag is day n-1's forecast: predicting one day at a time by hand agrees.
    state = engineered.orderBy(F.desc("date")).limit(1)
    lag = None
    for r in out[:3]:
        state = features.calendar_features(state.withColumn("date", F.lit(r.date)))
        if lag is not None:
            state = state.withColumn("lag_1", F.lit(float(lag)))
        by_hand = boosted.predict_boosted(model, used, state).first()[forecast.BOOSTED]
        assert r.predicted_demand == max(0, round(by_hand))
        lag = r.predicted_demand
    assert boosted.feature_importance(model, used)[0][1] > 0
