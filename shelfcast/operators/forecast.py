"""Candidate forecasts for every series at once.

``fit`` turns the learnt rows into one row per series: last value, recent values,
trend and seasonal parts.  Every step is an aggregate with map-side combine over
``(series)`` or ``(series, weekday, month, promotion)``, or a top-7 per series that
is cut before the shuffle, so the learnt rows themselves are never moved.
``predict`` joins that row to the days to forecast and evaluates all candidates as
columns.  The jointly fitted model is in ``additive``; the line and means here, taken one after
another, are the simpler candidate beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES, whole_series
from shelfcast.functions.numeric import non_negative, whole_units
from shelfcast.operators import additive

# Candidate order on ties, history needed by the seasonal parts.
NAIVE = "baseline_naive"
SEASONAL_NAIVE = "baseline_seasonal_naive"
TREND = "trend_seasonal"
ADDITIVE = "additive"
BOOSTED = "boosted_trees"
CANDIDATES = [BOOSTED, ADDITIVE, TREND, SEASONAL_NAIVE, NAIVE]
SEASON = 7
WEEKLY_AFTER_DAYS = additive.WEEKLY_AFTER_DAYS
YEARLY_AFTER_DAYS = additive.YEARLY_AFTER_DAYS
MIN_TRAIN_ROWS = 5


def _day_number(date: str = "date") -> Column:
    return F.unix_date(date).cast("double")


def _promotion(df: DataFrame) -> Column:
    return F.coalesce(F.col("is_promotion").cast("int"), F.lit(0)) if "is_promotion" in df.columns else F.lit(0)


# --- fitting: one row per series --------------------------------------------------------------


def fit_level(learnt: DataFrame) -> DataFrame:
    """M1 and the straight line of M4, with what the gates look at."""
    y, t = F.col("sales").cast("double"), _day_number()
    promo = _promotion(learnt)
    level = learnt.groupBy(*SERIES).agg(
        F.max_by(y, F.col("date")).alias("last_value"),
        F.max("date").alias("last_date"),
        F.datediff(F.max("date"), F.min("date")).alias("span"),
        (F.min(promo) < F.max(promo)).alias("varies"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(y), F.lit(0.0)).alias("total"),
        F.coalesce(F.regr_slope(y, t), F.lit(0.0)).alias("slope"),
        F.avg(y).alias("_y"),
        F.avg(t).alias("_t"),
    )
    return level.withColumn("intercept", F.col("_y") - F.col("slope") * F.col("_t")).drop("_y", "_t")


def fit_recent(learnt: DataFrame) -> DataFrame:
    """M2: the last seven values in order, and the newest of them by weekday."""
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("date"))
    last = (
        learnt.select(*SERIES, "date", F.col("sales").cast("double").alias("v"))
        .withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= SEASON)
    )
    by_day = last.groupBy(*SERIES, F.weekday("date").alias("dow")).agg(
        F.max_by("v", "date").alias("v"), F.collect_list(F.struct("date", "v")).alias("values")
    )
    return by_day.groupBy(*SERIES).agg(
        F.map_from_entries(F.collect_list(F.struct("dow", "v"))).alias("season"),
        F.transform(F.array_sort(F.flatten(F.collect_list("values"))), lambda x: x["v"]).alias("recent"),
    )


def fit_parts(learnt: DataFrame, level: DataFrame) -> DataFrame:
    """M4: ``level`` with the mean residual by weekday, then month, then promotion.

    Residual sums of a cell (weekday, month, promotion) follow from its count, sales
    and day numbers, so the parts are worked out on at most 168 cells per series.
    Weekly and yearly parts need more than two weeks and more than a year of
    history; the promotion part needs both kinds of days.
    """
    cells = (
        learnt.groupBy(*SERIES, F.weekday("date").alias("dow"), F.month("date").alias("month"), _promotion(learnt).alias("promo"))
        .agg(F.count("sales").alias("c"), F.sum(F.col("sales").cast("double")).alias("sy"), F.sum(_day_number()).alias("st"))
        .join(level, SERIES)
        .withColumn("rest", F.col("sy") - F.col("c") * F.col("intercept") - F.col("slope") * F.col("st"))
    )
    for key, part, gate in (
        ("dow", "weekly", F.col("span") > WEEKLY_AFTER_DAYS),
        ("month", "yearly", F.col("span") > YEARLY_AFTER_DAYS),
        ("promo", "promoted", F.col("varies")),
    ):
        over = whole_series(key)
        mean = F.try_divide(F.sum("rest").over(over), F.sum("c").over(over))
        cells = cells.withColumn(part, F.when(gate, F.coalesce(mean, F.lit(0.0))).otherwise(0.0))
        cells = cells.withColumn("rest", F.col("rest") - F.col("c") * F.col(part))

    def lookup(key: str, part: str) -> Column:
        return F.map_from_entries(F.collect_set(F.struct(key, part))).alias(part)

    kept = [c for c in level.columns if c not in SERIES]
    return (
        cells.groupBy(*SERIES)
        .agg(F.first(F.struct(*kept)).alias("_l"), lookup("dow", "weekly"), lookup("month", "yearly"), lookup("promo", "promoted"))
        .select(*SERIES, "_l.*", "weekly", "yearly", "promoted")
    )


def fit(learnt: DataFrame) -> DataFrame:
    """Everything the candidates know about a series, in one row."""
    parts = fit_parts(learnt, fit_level(learnt)).join(fit_recent(learnt), SERIES)
    return parts.join(additive.fit(learnt, _promotion(learnt)), SERIES)


# --- predicting: columns on the rows to forecast ------------------------------------------------


def _part(lookup: str, key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col(lookup), key), F.lit(0.0))


def naive() -> Column:
    """M1: the last learnt value."""
    return non_negative(F.coalesce("last_value", F.lit(0.0)))


def seasonal_naive() -> Column:
    """M2: the value of the same weekday among the last seven learnt rows, else the last value."""
    same_day = F.try_element_at(F.col("season"), F.weekday("date"))
    return non_negative(F.coalesce(same_day, F.col("last_value"), F.lit(0.0)))


def cycled_naive(step: Column) -> Column:
    """M2 without weekdays: the last seven values over and over; ``step`` counts from 1."""
    place = F.pmod(step.cast("int") - 1, F.size("recent")) + 1
    return non_negative(F.coalesce(F.when(F.size("recent") > 0, F.try_element_at(F.col("recent"), place)), F.lit(0.0)))


def trend_seasonal(promotion: Column) -> Column:
    """M4, clipped at 0 (M5)."""
    line = F.col("intercept") + F.col("slope") * _day_number()
    parts = _part("weekly", F.weekday("date")) + _part("yearly", F.month("date")) + _part("promoted", promotion)
    return non_negative(F.coalesce(line + parts, F.lit(0.0)))


def naive_only() -> Column:
    """M6: too few learnt rows, or nothing sold in them."""
    return F.coalesce((F.col("n") < MIN_TRAIN_ROWS) | (F.col("total") == 0), F.lit(True))


def predict(targets: DataFrame, fitted: DataFrame) -> DataFrame:
    """The rows to forecast with a column per candidate and the gate.

    Rows of series without history are kept; they get the naive zero.
    """
    joined = targets.join(fitted, SERIES, "left")
    columns = {
        NAIVE: naive(),
        SEASONAL_NAIVE: seasonal_naive(),
        TREND: trend_seasonal(_promotion(targets)),
        ADDITIVE: additive.additive(_promotion(targets)),
        "naive_only": naive_only(),
    }
    return joined.select(*[targets[c] for c in targets.columns], *[c.alias(name) for name, c in columns.items()])


def add_candidates(rows: DataFrame, *, learn: str = "learn") -> DataFrame:
    """Fit on the rows flagged ``learn`` and predict the others."""
    return predict(rows.where(~F.col(learn)), fit(rows.where(learn)))


def candidate_columns(df: DataFrame) -> list[str]:
    return [c for c in CANDIDATES if c in df.columns]


def to_long(rows: DataFrame) -> DataFrame:
    """``(series, date, model_type, y, yhat)``; gated series keep the naive forecast only."""
    models = candidate_columns(rows)
    pairs = F.array(*[F.struct(F.lit(m).alias("model_type"), F.col(m).alias("yhat")) for m in models])
    return (
        rows.select(*SERIES, "date", F.col("sales").alias("y"), "naive_only", F.inline(pairs))
        .where(~F.col("naive_only") | (F.col("model_type") == NAIVE))
        .drop("naive_only")
    )


# --- coming days ------------------------------------------------------------------------------


def future_rows(series: DataFrame, horizon: int) -> DataFrame:
    """``horizon`` days after each series' ``last_date``."""
    return series.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "date", F.date_add("last_date", F.col("step"))
    )


def forecast(panel: DataFrame, champions: DataFrame, horizon: int = 7) -> DataFrame:
    """The champion's forecast for the coming days, in whole units.

    The fitted row of a series grows into its coming days, so nothing is joined to
    the panel.  Promotions of coming days are not known: none are assumed.  Series
    without a champion give no rows; a champion that is not among the candidates
    here (a model kept elsewhere) falls back to zero.
    """
    served = fit(panel).join(champions.select(*SERIES, "model_type", "version", "wape", "reliability"), SERIES, "inner")
    values = {NAIVE: naive(), SEASONAL_NAIVE: seasonal_naive(), TREND: trend_seasonal(F.lit(0)), ADDITIVE: additive.additive(F.lit(0))}
    chosen = F.coalesce(*[F.when(F.col("model_type") == m, v) for m, v in values.items()], F.lit(0.0))
    return future_rows(served, horizon).select(
        *SERIES,
        "date",
        "step",
        F.col("model_type").alias("selected_model"),
        F.col("version").alias("model_version"),
        whole_units(chosen).alias("predicted_demand"),
        F.lit("WAPE").alias("validation_metric"),
        F.col("wape").alias("validation_score"),
        "reliability",
    )
