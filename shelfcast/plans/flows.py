"""End-to-end flows over the operators: training, recommendation, matching, health."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES
from shelfcast.operators import anomaly, boosted, exchange, features, forecast, inventory, monitor, selection
from shelfcast.operators.validate import validate, verdict
from shelfcast.plans.prepare import prepared
from shelfcast.session import materialise


@dataclass
class Boosted:
    """The pooled model and the features it reads."""

    model: GBTRegressionModel
    names: list[str]


def learn_boosted(engineered: DataFrame, *, trees: int = boosted.TREES) -> Boosted:
    """The pooled model of the training rows of an engineered (and written) panel."""
    split = features.chronological_split(engineered)
    return Boosted(*boosted.train_boosted(split.where(F.col("split") == "train"), features.numeric_features(engineered), trees=trees))


def learn_and_score(panel: DataFrame, *, dates: DataFrame | None = None, pooled: Boosted | None = None) -> DataFrame:
    """The panel's validation rows with every candidate's forecast, learnt from the training rows.

    With ``pooled`` the boosted trees are a candidate too; the panel then has their features.
    """
    split = features.chronological_split(panel, dates=dates)
    flagged = split.where(F.col("split") != "test").withColumn("learn", F.col("split") == "train")
    scored = forecast.add_candidates(flagged)
    return boosted.predict_boosted(pooled.model, pooled.names, scored) if pooled else scored


def choose_models(panel: DataFrame, current: DataFrame | None = None, *, pooled: Boosted | None = None) -> DataFrame:
    """Champion per series from a dense panel (an engineered one with ``pooled``)."""
    rows = panel if pooled else features.promotion_features(panel)
    scored = selection.score_candidates(learn_and_score(rows, pooled=pooled))
    return selection.select_champions(scored, current)


def coming_demand(panel: DataFrame, champions: DataFrame, horizon: int = 7, *, pooled: Boosted | None = None) -> DataFrame:
    """The champions' forecast; boosted champions are served recursively by ``pooled`` (an engineered panel then)."""
    rows = panel if pooled else features.promotion_features(panel)
    served = forecast.forecast(rows, champions, horizon)
    if pooled is None:
        return served
    trees = champions.where(F.col("model_type") == forecast.BOOSTED).select(*SERIES)
    days = boosted.forecast_recursive(pooled.model, pooled.names, panel.join(trees, SERIES, "left_semi"), horizon)
    days = days.select(*SERIES, "date", F.col("predicted_demand").alias("_boosted"))
    own = F.when(F.col("selected_model") == forecast.BOOSTED, F.coalesce("_boosted", "predicted_demand"))
    return (
        served.join(days, [*SERIES, "date"], "left")
        .withColumn("predicted_demand", own.otherwise(F.col("predicted_demand")))
        .select(*served.columns)
    )


@dataclass
class Training:
    """What a training run leaves behind, as tables."""

    findings: DataFrame
    verdict: DataFrame
    flags: DataFrame
    quality: DataFrame
    engineered: DataFrame
    champions: DataFrame
    pooled: Boosted | None = None


def train(
    raw: DataFrame,
    *,
    as_of: date,
    current: DataFrame | None = None,
    min_history: int = 30,
    scope: str = "observed",
    trees: int = boosted.TREES,
) -> Training:
    """Validate, scan, build features and choose champions, boosted trees among the candidates.

    A failed validation stops the run.  The daily table is built once: the scan reads the
    rows that exist, so a day without sales is no demand drop, and the panel grows from
    them.  The engineered panel is written once and read by every later step.  ``trees=0``
    leaves the pooled model out.
    """
    findings = materialise(validate(raw, min_history=min_history, as_of=as_of), "findings")
    outcome = verdict(findings)
    if outcome.where(F.col("status") == "FAIL").count():
        raise ValueError("validation failed; see the findings table")
    days, panel = prepared(raw, scope=scope)
    engineered = materialise(features.engineer(panel), "features")
    flags = anomaly.detect(features.promotion_features(features.calendar_features(days)))
    pooled = learn_boosted(engineered, trees=trees) if trees else None
    champions = materialise(choose_models(engineered, current, pooled=pooled), "champions")
    return Training(findings, outcome, flags, anomaly.quality(flags), engineered, champions, pooled)


def demand_plan(panel: DataFrame, horizon: int = 7) -> tuple[DataFrame, DataFrame]:
    """Champions and coming demand of a written panel, each written once.

    Both are small (a row per series, a row per series and coming day) and every
    later step reads them several times.
    """
    champions = materialise(choose_models(panel), "champions")
    return champions, materialise(coming_demand(panel, champions, horizon), "demand")


def recommendations(panel: DataFrame, stock: DataFrame, horizon: int = 7) -> DataFrame:
    """Forecast, demand, decision and surplus check for every stocked series."""
    return inventory.recommend(stock, demand_plan(panel, horizon)[1])


def matches(panel: DataFrame, listings: DataFrame, *, as_of: date) -> DataFrame:
    """Listings with the stores that will need their product."""
    return exchange.match(listings, demand_plan(panel)[1], as_of=as_of)


def served_forecasts(panel: DataFrame, champions: DataFrame, *, pooled: Boosted | None = None) -> DataFrame:
    """``(series, date, actual, forecast)`` of each series' champion on the test days."""
    split = features.chronological_split(panel)
    fitted = forecast.fit(split.where(F.col("split") == "train"))
    scored = forecast.predict(split.where(F.col("split") == "test"), fitted)
    if pooled:
        scored = boosted.predict_boosted(pooled.model, pooled.names, scored)
    served = scored.join(champions.select(*SERIES, "model_type"), SERIES)
    chosen = F.coalesce(
        *[F.when(F.col("model_type") == m, F.col(m)) for m in forecast.candidate_columns(scored)], F.lit(0.0)
    )
    return served.select(*SERIES, "date", F.col("sales").alias("actual"), chosen.alias("forecast"))


def health_reports(
    engineered: DataFrame, pairs: DataFrame, models: DataFrame, quality: DataFrame, *, dates: DataFrame | None = None
) -> DataFrame:
    """Health of every series with forecasts: drift from validation to test days and error.

    The features are read once, those of the later days only; they need not be written, and ``dates`` then names a
    written frame with the same dates.

    ``models`` are the registered champions with ``registered_at``; series without
    one are reported as missing.
    """
    names = features.numeric_features(engineered)
    return monitor.health(
        pairs,
        models.select(*SERIES, F.col("model_id").alias("version_id"), "wape", "registered_at"),
        later_sides(engineered, dates=dates),
        names,
        quality,
    )


def later_sides(rows: DataFrame, *, dates: DataFrame | None = None) -> DataFrame:
    """The validation and test days with their ``side``: reference and production."""
    split = features.chronological_split(rows, dates=dates)
    side = F.when(F.col("split") == "validation", "reference").when(F.col("split") == "test", "production")
    return split.where(F.col("split") != "train").withColumn("side", side).drop("split")
