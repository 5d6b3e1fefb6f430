"""Candidate forecasts, metrics, champions and coming demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.catalog import Entry, plain, rounded
from shelfcast.catalog.data import panel
from shelfcast.catalog.sql import part, query, r
from shelfcast.functions.keys import SERIES, by_date
from shelfcast.operators import additive, boosted, features, forecast, selection
from shelfcast.plans import flows
from shelfcast.session import materialise

ENTRIES: dict[str, Entry] = {}


def entry(name: str, sql: str | None = None):
    def add(run):
        ENTRIES[name] = Entry(lambda spark, folder: plain(run(spark, folder)), sql)
        return run

    return add


def split_rows(spark, folder) -> DataFrame:
    """Training and validation rows with the learn flag."""
    rows = features.chronological_split(features.promotion_features(panel(spark, folder)))
    return rows.where(F.col("split") != "test").withColumn("learn", F.col("split") == "train")


def candidates(spark, folder) -> DataFrame:
    return flows.learn_and_score(features.promotion_features(materialise(panel(spark, folder), "panel")))


_KEY = "store_id, product_id, date"


def targets_and_fit(spark, folder) -> DataFrame:
    """Validation rows beside what was learnt about their series."""
    rows = materialise(split_rows(spark, folder), "split")
    return rows.where(~F.col("learn")).join(forecast.fit(rows.where("learn")), SERIES)


@entry("m01_naive", query("v_cand", f"SELECT {_KEY}, baseline_naive FROM v_cand"))
def _(spark, folder):
    return targets_and_fit(spark, folder).select(*SERIES, "date", forecast.naive().alias(forecast.NAIVE))


@entry("m02_seasonal_naive", query("v_cand", f"SELECT {_KEY}, baseline_seasonal_naive FROM v_cand"))
def _(spark, folder):
    return targets_and_fit(spark, folder).select(*SERIES, "date", forecast.seasonal_naive().alias(forecast.SEASONAL_NAIVE))


@entry(
    "m02_cycled_naive",
    query(
        "v_known",
        """
, h AS (SELECT store_id, product_id, sales, 7 - recency AS slot FROM v_known WHERE recency <= 7),
 x AS (SELECT store_id, product_id, date, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date) - 1 AS i FROM v_rows WHERE NOT learn)
SELECT x.store_id, x.product_id, x.date, h.sales AS cycled_naive FROM x JOIN h ON x.store_id = h.store_id AND x.product_id = h.product_id AND x.i % 7 = h.slot
""",
    ),
)
def _(spark, folder):
    rows = targets_and_fit(spark, folder).withColumn("step", F.row_number().over(by_date()))
    return rows.select(*SERIES, "date", forecast.cycled_naive(F.col("step")).alias("cycled_naive"))


@entry("m04_m05_trend_seasonal", query("v_cand", f"SELECT {_KEY}, {r('trend_seasonal')} AS trend_seasonal FROM v_cand"))
def _(spark, folder):
    rows = targets_and_fit(spark, folder)
    return rounded(rows.select(*SERIES, "date", forecast.trend_seasonal(F.col("is_promotion")).alias(forecast.TREND)))


@entry("m04_additive", query("v_cand", f"SELECT {_KEY}, {r('additive')} AS additive FROM v_cand"))
def _(spark, folder):
    rows = targets_and_fit(spark, folder)
    return rounded(rows.select(*SERIES, "date", additive.additive(F.col("is_promotion")).alias(forecast.ADDITIVE)))


@entry(
    "m04_additive_coefficients",
    query(
        "v_solve",
        f"""
SELECT store_id, product_id, i - 1 AS term, {r(f"a[i][{additive.SIZE + 1}]")} AS coefficient
FROM v_solve, range(1, {additive.SIZE + 1}) AS g(i) WHERE step = {additive.SIZE + 1}
""",
    ),
)
def _(spark, folder):
    """One row per series and term of the jointly fitted model."""
    learnt = materialise(split_rows(spark, folder).where("learn"), "learnt")
    found = additive.fit(learnt, F.col("is_promotion"))
    return rounded(found.select(*SERIES, F.posexplode("additive").alias("term", "coefficient")))


@entry(
    "m11_wape_by_model",
    query(
        "v_long",
        f"""
, m AS (SELECT model_type, sum(abs(y - yhat)) / sum(y) * 100 AS wape, count(*) AS n FROM v_long GROUP BY model_type),
c AS (SELECT model_type, count(*) AS series FROM (SELECT DISTINCT store_id, product_id, model_type FROM v_long) GROUP BY model_type)
SELECT model_type, {r('wape')} AS wape, n, series FROM m JOIN c USING (model_type)
""",
    ),
)
def _(spark, folder):
    """What each candidate errs over all series together."""
    long = forecast.to_long(candidates(spark, folder))
    per = long.groupBy("model_type", *SERIES).agg(
        F.sum(F.abs(F.col("y") - F.col("yhat"))).alias("e"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")
    )
    total = per.groupBy("model_type").agg(
        (F.sum("e") / F.sum("y") * 100).alias("wape"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("series")
    )
    return rounded(total)


@entry(
    "m06_candidates_long",
    query("v_long", f"SELECT {_KEY}, y, model_type, {r('yhat')} AS yhat FROM v_long"),
)
def _(spark, folder):
    return rounded(forecast.to_long(candidates(spark, folder)))


_SCORES = "store_id, product_id, model_type, mae, rmse, mape, wape, n, reliability"


@entry("m07_m11_scores", query("scores", f"SELECT {_SCORES} FROM scores"))
def _(spark, folder):
    return selection.score_candidates(candidates(spark, folder))


@entry("m11_scores_from_long", query("scores", f"SELECT {_SCORES} FROM scores"))
def _(spark, folder):
    return selection.score(forecast.to_long(candidates(spark, folder)))


@entry("m12_best", query("best", f"SELECT {_SCORES} FROM best"))
def _(spark, folder):
    return selection.best(selection.score_candidates(candidates(spark, folder)))


# Models in service before the run: the type follows from the names, the version from the brand.
_BRAND = "CAST(substr(product_id, 7) AS INTEGER)"
part(
    "serving",
    "days",
    f"""
SELECT store_id, product_id, CASE ({_BRAND} + length(store_id)) % 4 WHEN 0 THEN 'trend_seasonal' WHEN 1 THEN 'baseline_seasonal_naive'
       WHEN 2 THEN 'baseline_naive' ELSE 'boosted_trees' END AS champion_type, {_BRAND} % 5 + 1 AS champion_version
FROM (SELECT DISTINCT store_id, product_id FROM days)
""",
)


def serving(rows: DataFrame) -> DataFrame:
    brand = F.substring("product_id", 7, 9).cast("int")
    kind = (brand + F.length("store_id")) % 4
    return (
        rows.select(*SERIES)
        .distinct()
        .select(
            *SERIES,
            F.when(kind == 0, forecast.TREND)
            .when(kind == 1, forecast.SEASONAL_NAIVE)
            .when(kind == 2, forecast.NAIVE)
            .otherwise(forecast.BOOSTED)
            .alias("model_type"),
            (brand % 5 + 1).alias("version"),
        )
    )


@entry(
    "m13_m14_champions",
    query(
        "ranked serving",
        """
, h AS (SELECT s.*, champion_type, champion_version FROM ranked s JOIN serving USING (store_id, product_id)),
b AS (SELECT * FROM h WHERE place = 1), c AS (SELECT * FROM h WHERE model_type = champion_type),
k AS (SELECT b.store_id, b.product_id, coalesce(c.model_type <> b.model_type AND c.wape > 0 AND (c.wape - b.wape) / c.wape * 100 < 2, false) AS kept_champion
      FROM b LEFT JOIN c ON b.store_id = c.store_id AND b.product_id = c.product_id),
p AS (SELECT h.*, kept_champion FROM h JOIN k USING (store_id, product_id)
      WHERE CASE WHEN kept_champion THEN h.model_type = h.champion_type ELSE h.place = 1 END)
SELECT store_id, product_id, store_id || '_' || product_id || '_' || model_type || '_v' || v AS model_id, model_type, mae, rmse, mape, wape, reliability,
       v AS version, 'production' AS status, kept_champion, n AS candidates
FROM (SELECT p.* EXCLUDE (n), CASE WHEN model_type = champion_type THEN champion_version + 1 ELSE 1 END AS v,
             (SELECT count(*) FROM scores s WHERE s.store_id = p.store_id AND s.product_id = p.product_id) AS n FROM p)
""",
    ),
)
def _(spark, folder):
    dense = materialise(panel(spark, folder), "panel")
    chosen = flows.choose_models(dense, serving(dense))
    return chosen.withColumn("candidates", F.size("all_results")).drop("all_results")


@entry(
    "m15_future_dates",
    query("f_rows", "SELECT store_id, product_id, date FROM f_rows WHERE NOT learn"),
)
def _(spark, folder):
    return forecast.future_rows(forecast.fit_level(panel(spark, folder)), 7).select(*SERIES, "date")


_COMING = """store_id, product_id, date, selected_model, CAST(model_version AS BIGINT) AS model_version, predicted_demand,
 'WAPE' AS validation_metric, validation_score, reliability"""


def coming(spark, folder, horizon: int = 7) -> tuple[DataFrame, DataFrame]:
    """The panel's champions and their forecast."""
    return flows.demand_plan(materialise(panel(spark, folder), "panel"), horizon)


@entry("m17_forecast", query("coming", f"SELECT {_COMING} FROM coming"))
def _(spark, folder):
    return coming(spark, folder)[1].drop("step")


@entry(
    "m18_fallback",
    query(
        "f_cand best serving",
        """
SELECT c.store_id, c.product_id, c.date, s.champion_type AS selected_model,
       greatest(CAST(round_even(CASE s.champion_type WHEN 'trend_seasonal' THEN trend_seasonal WHEN 'baseline_seasonal_naive' THEN baseline_seasonal_naive
            WHEN 'baseline_naive' THEN baseline_naive ELSE 0 END, 0) AS BIGINT), 0) AS predicted_demand
FROM f_cand c JOIN serving s ON c.store_id = s.store_id AND c.product_id = s.product_id WHERE s.champion_version > 2
""",
    ),
)
def _(spark, folder):
    """Series without a model give no rows; a model that is not here gives zeros."""
    dense = materialise(panel(spark, folder), "panel")
    models = serving(dense).where(F.col("version") > 2).withColumns({"wape": F.lit(0.0), "reliability": F.lit("Low")})
    return flows.coming_demand(dense, models).select(*SERIES, "date", "selected_model", "predicted_demand")


def _learnt(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Written features of the observed days, and their split."""
    engineered = materialise(features.engineer(panel(spark, folder)), "features")
    return engineered, features.chronological_split(engineered)


@entry("m03_boosted_trees")
def _(spark, folder):
    """The pooled model beside the other candidates, scored on the validation rows."""
    engineered, split = _learnt(spark, folder)
    rows = split.where(F.col("split") != "test").withColumn("learn", F.col("split") == "train")
    model, names = boosted.train_boosted(rows.where("learn"), features.numeric_features(engineered))
    scored = forecast.add_candidates(rows)
    return selection.score_candidates(boosted.predict_boosted(model, names, scored))


@entry("m17_boosted_champions")
def _(spark, folder):
    """Champions with the pooled trees as a candidate, and their demand of the coming week."""
    engineered = materialise(features.engineer(panel(spark, folder)), "features")
    pooled = flows.learn_boosted(engineered)
    champions = materialise(flows.choose_models(engineered, pooled=pooled), "champions")
    demand = flows.coming_demand(engineered, champions, pooled=pooled)
    week = demand.groupBy(*SERIES).agg(F.sum("predicted_demand").alias("week_demand"), F.count(F.lit(1)).alias("days"))
    chosen = champions.select(*SERIES, "model_type", F.size("all_results").alias("candidates"), "wape")
    return chosen.join(week, SERIES)


@entry("m16_recursive_forecast")
def _(spark, folder):
    engineered, split = _learnt(spark, folder)
    model, names = boosted.train_boosted(split.where(F.col("split") == "train"), features.numeric_features(engineered))
    return boosted.forecast_recursive(model, names, engineered, horizon=7)
