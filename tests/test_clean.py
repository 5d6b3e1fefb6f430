import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.quantiles import _ranked, group_quantiles
from shelfcast.functions.skew import all_pairs_of, skew_join
from shelfcast.operators import clean
from shelfcast.plans.prepare import sales_panel


def test_daily_aggregate_and_defaults(spark):
    rows = [
        ("2026-01-01", "S", "P", 1.0, 10.0, 0.0),
        ("2026-01-01", "S", "P", None, 20.0, 0.1),
        ("bad", "S", "P", 5.0, 1.0, 0.0),
        ("2026-01-02", None, "P", 5.0, 1.0, 0.0),
    ]
    df = spark.createDataFrame(
        rows, "Date string, Location string, Product_Name string, Quantity double, Unit_Price double, Discount_Applied double"
    )
    (row,) = clean.daily(df).collect()
    assert (row.sales, row.price, row.promotion, row.safety_stock, row.lead_time_days) == (1.0, 15.0, 1, 20, 2)


def test_supplied_columns_survive_or_not(spark):
    df = spark.createDataFrame(
        [("2026-01-01", "S", "P", 1.0, 1, 7)], "date string, store_id string, product_id string, sales double, promotion int, safety_stock int"
    )
    kept = clean.daily(df).first()
    reset = clean.daily(df, carry_supplied=False).first()
    assert (kept.promotion, kept.safety_stock) == (1, 7)
    assert (reset.promotion, reset.safety_stock) == (0, 20)


def raw_table(seed=3):
    rng = random.Random(seed)
    rows = []
    for s in "AB":
        for p in "XYZ":
            if (s, p) == ("B", "Z"):
                continue
            for _ in range(rng.randint(3, 25)):
                day = date(2026, 1, 1) + timedelta(days=rng.randint(0, 40))
                price = None if rng.random() < 0.3 else float(rng.randint(1, 9))
                rows.append((day, s, p, float(rng.randint(0, 30)), price, rng.choice([0.0, 0.1])))
    return rows


def by_hand(rows):
    """The same steps in pandas."""
    df = pd.DataFrame(rows, columns=["date", "store_id", "product_id", "sales", "price", "disc"])
    df["date"] = pd.to_datetime(df["date"])
    d = df.groupby(["date", "store_id", "product_id"]).agg(sales=("sales", "sum"), price=("price", "mean"), disc=("disc", "max")).reset_index()
    d["promotion"] = (d.disc > 0).astype(int)
    d["price"] = d.groupby("product_id").price.transform(lambda x: x.fillna(x.median())).fillna(0)
    q1 = d.groupby(["store_id", "product_id"]).sales.transform(lambda x: x.quantile(0.25))
    q3 = d.groupby(["store_id", "product_id"]).sales.transform(lambda x: x.quantile(0.75))
    d["is_outlier"] = (d.sales > q3 + 1.5 * (q3 - q1)).astype(int)
    grid = pd.MultiIndex.from_product(
        [d.store_id.unique(), d.product_id.unique(), pd.date_range(d.date.min(), d.date.max())], names=["store_id", "product_id", "date"]
    ).to_frame(index=False)
    out = grid.merge(d, how="left", on=["store_id", "product_id", "date"])
    for c in ("sales", "promotion", "is_outlier"):
        out[c] = out[c].fillna(0)
    out["price"] = out.groupby(["store_id", "product_id"]).price.transform(lambda x: x.ffill().bfill())
    return out


def test_panel_equals_the_same_steps_in_pandas(spark):
    rows = raw_table()
    df = spark.createDataFrame(
        rows, "date date, store_id string, product_id string, sales double, price double, Discount_Applied double"
    )
    want = {
        (r.store_id, r.product_id, r.date.date()): (r.sales, int(r.promotion), int(r.is_outlier), None if pd.isna(r.price) else round(r.price, 9))
        for r in by_hand(rows).itertuples()
    }
    for made in (sales_panel(df, scope="global"), clean.densify(clean.clean(df), scope="global")):
        got = {
            (r.store_id, r.product_id, r.date): (r.sales, r.promotion, r.is_outlier, None if r.price is None else round(r.price, 9))
            for r in made.collect()
        }
        assert got == want


def test_observed_scope_covers_each_series_range_only(spark):
    df = spark.createDataFrame(
        [(date(2026, 1, 1), "A", "X", 1.0), (date(2026, 1, 4), "A", "X", 2.0), (date(2026, 1, 9), "B", "Y", 3.0)],
        "date date, store_id string, product_id string, sales double",
    )
    got = {(r.store_id, r.date.day): r.sales for r in clean.densify(clean.clean(df), scope="observed").collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 0.0, ("A", 3): 0.0, ("A", 4): 2.0, ("B", 9): 3.0}


def test_mixed_categories_keep_their_rows(spark):
    df = spark.createDataFrame(
        [(date(2026, 1, 1), "A", "X", "c1", 1.0), (date(2026, 1, 1), "A", "X", "c2", 2.0), (date(2026, 1, 3), "A", "X", "c1", 4.0)],
        "date date, store_id string, product_id string, category string, sales double",
    )
    rows = clean.densify(clean.clean(df, by_category=True), scope="global").orderBy("date", "category").collect()
    assert [(r.date.day, r.category, r.sales) for r in rows] == [(1, "c1", 1.0), (1, "c2", 2.0), (2, "c2", 0.0), (3, "c1", 4.0)]


def test_quantiles_are_exact_for_groups_of_all_sizes(spark):
    rng = random.Random(1)
    rows = [("hot", rng.gauss(0, 5)) for _ in range(40000)] + [("hot", 1.0)] * 5000 + [("cold", float(i)) for i in range(7)] + [("one", 3.0), ("cold", None)]
    rows += [(f"n{n}", float(rng.randint(0, 9))) for n in range(2, 14) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    truth = {k: [pd.Series([v for x, v in rows if x == k and v is not None]).quantile(p) for p in probs] for k in {r[0] for r in rows}}
    got = None
    for parts in (1, 7):
        before, got = got, {r.k: r.quantiles for r in group_quantiles(df.repartition(parts), ["k"], "v", probs).collect()}
        assert before is None or before == got
    assert set(got) == set(truth)
    for k in truth:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], truth[k])), k


def test_a_bracket_that_misses_its_rank_raises(spark):
    counts = spark.createDataFrame([("a", float(i), 1) for i in range(100)], "k string, _v double, _n long")
    sketch = spark.createDataFrame([("a", [10.0, 12.0], 100)], "k string, _edges array<double>, _total long")
    with pytest.raises(Exception, match="outside its bracket"):
        _ranked(counts, sketch, ["k"], [0.5], "q").collect()
    right = spark.createDataFrame([("a", [49.0, 49.0], 100)], "k string, _edges array<double>, _total long")
    assert _ranked(counts, right, ["k"], [0.5], "q").first().q == [49.5]


def test_skew_join_equals_plain_join(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = {tuple(r) for r in rows.join(lookup, "k", how).select("id", "k", "v").collect()}
        joined = skew_join(rows, lookup, ["k"], spread=["id"], how=how, shares=10).select("id", "k", "v").collect()
        assert len(joined) == len(want) and {tuple(r) for r in joined} == want


def test_all_pairs(spark):
    pairs = all_pairs_of(spark.createDataFrame([("a",), ("b",)], "s string"), spark.createDataFrame([(str(i),) for i in range(9)], "p string"), "p", slots=4)
    assert len({tuple(r) for r in pairs.collect()}) == 18 == pairs.count()


def test_dense_grid_needs_one_shuffle_for_panel_and_features(spark):
    from shelfcast.operators import features

    df = spark.createDataFrame(raw_table(), "date date, store_id string, product_id string, sales double, price double, Discount_Applied double")
    plan = features.engineer(sales_panel(df, scope="observed"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(store_id") == 1
