"""One boosted-tree model pooled over all series (M3) and its recursive use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES
from shelfcast.functions.numeric import non_negative, whole_units
from shelfcast.operators.features import calendar_features, numeric_features
from shelfcast.operators.forecast import BOOSTED
from shelfcast.session import cut_lineage, ensure_checkpoint_dir

# Settings of the model.
TREES = 100
LEARNING_RATE = 0.1
DEPTH = 5
SEED = 42
CUT_EVERY = 5


def _vectors(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing history counts as 0; the has_lag flags tell it from a real 0."""
    filled = rows.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})
    names = [f"_f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="_features").transform(filled).drop(*names)


def train_boosted(
    learnt: DataFrame, features: Sequence[str] | None = None, *, trees: int = TREES, depth: int = DEPTH
) -> tuple[GBTRegressionModel, list[str]]:
    """Fit on the learnt rows of all series together.

    Split statistics are aggregated over partitions, so the driver holds the
    trees and per-level histograms, never rows.
    """
    ensure_checkpoint_dir(learnt.sparkSession)
    features = list(features or numeric_features(learnt))
    model = GBTRegressor(
        featuresCol="_features",
        labelCol="sales",
        predictionCol="_prediction",
        maxIter=trees,
        stepSize=LEARNING_RATE,
        maxDepth=depth,
        seed=SEED,
        checkpointInterval=10,
        # Node ids are kept between levels; the histograms of a level fit one pass.
        cacheNodeIds=True,
        maxMemoryInMB=1024,
    ).fit(_vectors(learnt, features).select("sales", "_features"))
    return model, features


def predict_boosted(model: GBTRegressionModel, features: Sequence[str], rows: DataFrame) -> DataFrame:
    out = model.transform(_vectors(rows, features))
    return out.withColumn(BOOSTED, non_negative(F.col("_prediction"))).drop("_features", "_prediction")


def feature_importance(model: GBTRegressionModel, features: Sequence[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, (float(x) for x in model.featureImportances.toArray())), key=lambda p: -p[1])


def forecast_recursive(
    model: GBTRegressionModel, features: Sequence[str], panel: DataFrame, horizon: int = 7
) -> DataFrame:
    """Each day's forecast becomes the next day's ``lag_1``.

    The state is one row per series (its newest), so a step costs one narrow
    transform over the series; all calendar features follow the day.  Lineage is
    cut every few steps.
    """
    newest = panel.groupBy(*SERIES).agg(F.max_by(F.struct(*[c for c in panel.columns if c not in SERIES]), "date").alias("_r"))
    state = newest.select(*SERIES, "_r.*")
    # Every day adds its forecast to an array, so the state stays one row per series.
    state = state.withColumn("_days", F.array().cast("array<struct<date:date,step:int,predicted_demand:bigint>>"))
    for step in range(1, horizon + 1):
        state = predict_boosted(model, features, calendar_features(state.withColumn("date", F.date_add("date", 1))))
        demand = whole_units(F.col(BOOSTED))
        day = F.struct(F.col("date"), F.lit(step).alias("step"), demand.alias("predicted_demand"))
        state = state.withColumn("_days", F.array_append("_days", day))
        if "lag_1" in panel.columns:
            state = state.withColumn("lag_1", demand.cast("double"))
        state = state.drop(BOOSTED)
        if step % CUT_EVERY == 0 and step < horizon:
            state = cut_lineage(state)
    return state.select(*SERIES, F.inline("_days"))
