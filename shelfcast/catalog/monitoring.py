"""Drift, error, health, decisions and the model registry."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.catalog import Entry, plain, rounded
from shelfcast.catalog.data import panel, panel_and_scan
from shelfcast.catalog.forecasting import serving
from shelfcast.catalog.sql import PARTS, part, query, r
from shelfcast.functions.keys import SERIES
from shelfcast.operators import anomaly, features, monitor, registry, selection, sketches
from shelfcast.plans import flows
from shelfcast.session import materialise
from shelfcast.sources import retail

ENTRIES: dict[str, Entry] = {}


def entry(name: str, sql: str | None = None):
    def add(run):
        ENTRIES[name] = Entry(lambda spark, folder: plain(run(spark, folder)), sql)
        return run

    return add


_FEATURES = [
    "promotion",
    *["day_of_week", "day_of_month", "week_of_year", "month", "quarter", "day_of_year", "is_weekend"],
    *["sin_day_of_week", "cos_day_of_week", "sin_month", "cos_month"],
    *[f"lag_{n}" for n in features.LAGS],
    *[f"has_lag_{n}" for n in features.LAGS],
    *["rolling_mean_7", "rolling_std_7", "rolling_min_7", "rolling_max_7", "rolling_mean_14"],
    *["rolling_mean_28", "rolling_std_28", "rolling_min_28", "rolling_max_28"],
    *["trend_ratio", "is_promotion", "previous_price", "price_change", "price_change_pct"],
]
_DERIVED = {
    **{f"has_lag_{n}": f"CASE WHEN lag_{n} IS NULL THEN 0 ELSE 1 END" for n in features.LAGS},
    "trend_ratio": "CASE WHEN rolling_mean_28 = 0 THEN 0 ELSE rolling_mean_7 / rolling_mean_28 END",
    "price_change": "price - previous_price",
    "price_change_pct": "CASE WHEN previous_price = 0 THEN 0 ELSE (price - previous_price) / previous_price END",
}
part(
    "sides",
    "featured labels",
    f"""
SELECT store_id, product_id, split, feature, position, value FROM (
  SELECT store_id, product_id, split, unnest([{', '.join(f"round(CAST({_DERIVED.get(f, f)} AS DOUBLE), 6)" for f in _FEATURES)}]) AS value,
         unnest([{', '.join(f"'{f}'" for f in _FEATURES)}]) AS feature, unnest(range({len(_FEATURES)})) AS position
  FROM featured JOIN labels USING (date) WHERE split <> 'train') WHERE value IS NOT NULL
""",
)
part(
    "edges",
    "sides",
    """
SELECT store_id, product_id, feature, position, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e
FROM sides WHERE split = 'validation' GROUP BY ALL
""",
)
part(
    "binned",
    "sides edges",
    """
SELECT s.store_id, s.product_id, s.feature, split, least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) AS bin, count(*) AS c
FROM sides s JOIN edges USING (store_id, product_id, feature) WHERE len(e) > 1 AND value >= e[1] AND value <= e[-1] GROUP BY ALL
""",
)
part(
    "cells",
    "edges binned",
    """
SELECT g.store_id, g.product_id, g.feature, greatest(coalesce(a.c, 0), 1) AS rc, greatest(coalesce(b.c, 0), 1) AS pc
FROM (SELECT store_id, product_id, feature, unnest(range(1, len(e))) AS bin FROM edges) g
LEFT JOIN binned a ON a.split = 'validation' AND a.store_id = g.store_id AND a.product_id = g.product_id AND a.feature = g.feature AND a.bin = g.bin
LEFT JOIN binned b ON b.split = 'test' AND b.store_id = g.store_id AND b.product_id = g.product_id AND b.feature = g.feature AND b.bin = g.bin
""",
)
part(
    "drift",
    "edges cells",
    """
SELECT e.store_id, e.product_id, e.feature, e.position, coalesce(psi, 0) AS psi,
       CASE WHEN coalesce(psi, 0) < 0.1::DOUBLE THEN 'LOW' WHEN psi < 0.25::DOUBLE THEN 'MODERATE' ELSE 'HIGH' END AS status
FROM edges e LEFT JOIN (
  SELECT store_id, product_id, feature, sum((p - q) * ln(p / q)) AS psi FROM (
    SELECT store_id, product_id, feature, pc / sum(pc) OVER f AS p, rc / sum(rc) OVER f AS q FROM cells
    WINDOW f AS (PARTITION BY store_id, product_id, feature)) GROUP BY ALL) USING (store_id, product_id, feature)
""",
)
part(
    "drifted",
    "drift",
    """
SELECT store_id, product_id, count(*) AS total_features, count_if(status <> 'LOW') AS features_with_drift,
       round_even(count_if(status <> 'LOW') / count(*) * 100, 2) AS percentage_drifted,
       CASE WHEN max(psi) > 0 THEN arg_max(feature, psi) ELSE 'None' END AS highest_drift_feature
FROM drift GROUP BY store_id, product_id
""",
)
part(
    "served",
    "t_cand best",
    """
SELECT c.store_id, c.product_id, c.date, greatest(c.sales, 0) AS a, model_type, wape AS trained_wape,
       CASE model_type WHEN 'additive' THEN additive WHEN 'trend_seasonal' THEN trend_seasonal WHEN 'baseline_seasonal_naive' THEN baseline_seasonal_naive ELSE baseline_naive END AS f
FROM t_cand c JOIN best b ON c.store_id = b.store_id AND c.product_id = b.product_id
JOIN labels l ON c.date = l.date WHERE split = 'test'
""",
)
part(
    "errors",
    "served",
    """
SELECT store_id, product_id, avg(a - f) AS bias, avg(abs(a - f)) AS mae, sqrt(avg((a - f) * (a - f))) AS rmse,
       CASE WHEN sum(a) > 0 THEN sum(abs(a - f)) / sum(a) ELSE avg(abs(a - f)) END AS wape,
       stddev_pop(a - f) AS residual_std, avg(a) AS mean_a, max(trained_wape) / 100 AS ref_wape
FROM served GROUP BY store_id, product_id
""",
)
part(
    "performed",
    "errors",
    """
SELECT *, CASE WHEN degradation > 0.2::DOUBLE THEN 'PERFORMANCE_DEGRADATION' WHEN wape > 0.15::DOUBLE THEN 'HIGH_ERROR'
       WHEN abs(bias) / (mean_a + 1e-5::DOUBLE) > 0.1::DOUBLE THEN 'HIGH_BIAS' ELSE 'HEALTHY' END AS status
FROM (SELECT *, CASE WHEN ref_wape > 0 THEN (wape - ref_wape) / ref_wape ELSE 0 END AS degradation FROM errors)
""",
)

_FIGURES = ", ".join(
    f"round_even({e}, 4) + 0.0 AS {n}"
    for e, n in (
        ("wape", "wape"),
        ("mae", "mae"),
        ("rmse", "rmse"),
        ("bias", "bias"),
        ("bias", "residual_mean"),
        ("residual_std", "residual_std"),
        ("degradation", "degradation"),
    )
)


def drift_of_written(dense: DataFrame) -> DataFrame:
    """Drift without writing features: only the later days' are made, and they go where they are counted."""
    frame = rounded(features.engineer(dense), 6)
    return monitor.side_drift(flows.later_sides(frame, dates=dense), features.numeric_features(frame))


def drift_of_panel(spark, folder) -> DataFrame:
    return drift_of_written(materialise(panel(spark, folder), "panel"))


@entry(
    "d01_d02_feature_drift",
    query("drift", f"SELECT store_id, product_id, feature, {r('psi')} AS psi, {r('psi', 3)} AS drift_score, status FROM drift"),
)
def _(spark, folder):
    return rounded(drift_of_panel(spark, folder).drop("position"))


@entry(
    "d03_drift_summary",
    query("drifted", "SELECT * REPLACE (CAST(features_with_drift AS BIGINT) AS features_with_drift) FROM drifted"),
)
def _(spark, folder):
    return monitor.drift_summary(drift_of_panel(spark, folder))


# Two calendar years, compared month by month from sketches.
_YEARS = ((date(1999, 1, 1), date(1999, 12, 31)), (date(2000, 1, 1), date(2000, 12, 31)))
part(
    "feature_values",
    "featured",
    f"""
SELECT store_id, product_id, date, feature, value FROM (
  SELECT store_id, product_id, date, unnest([{', '.join(f"round(CAST({_DERIVED.get(f, f)} AS DOUBLE), 6)" for f in _FEATURES)}]) AS value,
         unnest([{', '.join(f"'{f}'" for f in _FEATURES)}]) AS feature FROM featured) WHERE value IS NOT NULL
""",
)
part(
    "year_values",
    "feature_values",
    f"""
SELECT *, date >= DATE '{_YEARS[1][0]}' AS late FROM feature_values WHERE date BETWEEN '{_YEARS[0][0]}' AND '{_YEARS[1][1]}'
""",
)


def monthly_sketches(spark, folder) -> DataFrame:
    frame = rounded(features.engineer(materialise(panel(spark, folder), "panel")), 6)
    return materialise(sketches.monthly(frame, features.numeric_features(frame)), "sketches")


@entry(
    "d01_monthly_sketches",
    query(
        "feature_values",
        """
SELECT store_id, product_id, CAST(date_trunc('month', date) AS DATE) AS month, feature, count(*) AS n, quantile_disc(value, 0.5) + 0.0 AS middle, max(value) + 0.0 AS most
FROM feature_values GROUP BY ALL
""",
    ),
)
def _(spark, folder):
    """What the stored sketches of every month say of each feature."""
    read = sketches.quantiles("sketch", [0.5, 1.0])
    kept = monthly_sketches(spark, folder).withColumn("_q", read)
    return kept.select(*SERIES, "month", "feature", "n", (F.col("_q")[0] + 0.0).alias("middle"), (F.col("_q")[1] + 0.0).alias("most"))


@entry(
    "d02_sketch_drift",
    query(
        "year_values",
        f"""
, e AS (SELECT store_id, product_id, feature, list_sort(list_distinct(quantile_disc(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e
        FROM year_values WHERE NOT late GROUP BY ALL),
b AS (SELECT v.store_id, v.product_id, v.feature, late, least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) AS bin, count(*) AS c
      FROM year_values v JOIN e USING (store_id, product_id, feature) WHERE len(e) > 1 AND value >= e[1] AND value <= e[-1] GROUP BY ALL),
g AS (SELECT g.store_id, g.product_id, g.feature, greatest(coalesce(x.c, 0), 1) AS rc, greatest(coalesce(y.c, 0), 1) AS pc
      FROM (SELECT store_id, product_id, feature, unnest(range(1, len(e))) AS bin FROM e) g
      LEFT JOIN b x ON NOT x.late AND x.store_id = g.store_id AND x.product_id = g.product_id AND x.feature = g.feature AND x.bin = g.bin
      LEFT JOIN b y ON y.late AND y.store_id = g.store_id AND y.product_id = g.product_id AND y.feature = g.feature AND y.bin = g.bin),
i AS (SELECT store_id, product_id, feature, sum((p - q) * ln(p / q)) AS psi FROM (
      SELECT store_id, product_id, feature, pc / sum(pc) OVER f AS p, rc / sum(rc) OVER f AS q FROM g WINDOW f AS (PARTITION BY store_id, product_id, feature))
      GROUP BY ALL)
SELECT e.store_id, e.product_id, e.feature, {r('coalesce(psi, 0)')} AS psi, {r('coalesce(psi, 0)', 3)} AS drift_score,
       CASE WHEN coalesce(psi, 0) < 0.1::DOUBLE THEN 'LOW' WHEN psi < 0.25::DOUBLE THEN 'MODERATE' ELSE 'HIGH' END AS status
FROM e LEFT JOIN i USING (store_id, product_id, feature)
""",
    ),
)
def _(spark, folder):
    """Drift between two years from the months' sketches; a year's values fit a sketch, so it is exact."""
    found = sketches.drift(monthly_sketches(spark, folder), *_YEARS)
    return rounded(found.drop("position"))


_RANKED = ["lag_1", "rolling_mean_7", "rolling_mean_28", "rolling_std_28", "previous_price"]


@entry(
    "d02_sketch_rank_error",
    query(
        "year_values",
        f"""
SELECT feature, count(*) AS n, 9 AS quantiles, 9 AS within FROM year_values
WHERE NOT late AND feature IN ({', '.join(f"'{f}'" for f in _RANKED)}) GROUP BY feature
""",
    ),
)
def _(spark, folder):
    """All series' sketches of a year merged: how many deciles lie within the stated rank error of the rows."""
    frame = rounded(features.engineer(materialise(panel(spark, folder), "panel")), 6)
    kept = sketches.monthly(frame, _RANKED)
    shares = [i / 10 for i in range(1, 10)]
    year = sketches.merged(kept, [], first=_YEARS[0][0], last=_YEARS[0][1]).withColumn("q", sketches.quantiles("sketch", shares))
    told = year.agg(F.map_from_entries(F.collect_list(F.struct("feature", "q")))).scalar()  # one row of 5 x 9 numbers
    rows = frame.where(F.col("date").between(*_YEARS[0])).select(*_RANKED, told.alias("_told"))

    def sums(f: str, i: int) -> list:
        at = F.col("_told")[f][i]
        return [F.count_if(F.col(f) < at).alias(f"{f}_u{i}"), F.count_if(F.col(f) <= at).alias(f"{f}_o{i}")]

    counted = rows.agg(*[F.count(f).alias(f"{f}_n") for f in _RANKED], *[c for f in _RANKED for i in range(len(shares)) for c in sums(f, i)])

    def hits(f: str):
        n = F.col(f"{f}_n")
        ok = [
            ((F.col(f"{f}_u{i}") - n * sketches.rank_error() <= n * p) & (F.col(f"{f}_o{i}") + n * sketches.rank_error() >= n * p)).cast("int")
            for i, p in enumerate(shares)
        ]
        return F.struct(F.lit(f).alias("feature"), n.alias("n"), F.lit(len(shares)).alias("quantiles"), sum(ok, F.lit(0)).alias("within"))

    return counted.select(F.inline(F.array(*[hits(f) for f in _RANKED])))


def served(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Champions chosen on the validation days, and their error on the test days."""
    champions = materialise(selection.select_champions(selection.score_candidates(flows.learn_and_score(frame))), "champions")
    return champions, flows.served_forecasts(frame, champions)


@entry("d04_d05_performance", query("performed", f"SELECT store_id, product_id, {_FIGURES}, status FROM performed"))
def _(spark, folder):
    champions, pairs = served(materialise(features.promotion_features(panel(spark, folder)), "panel"))
    return monitor.performance(pairs, champions.select(*SERIES, (F.col("wape") / 100).alias("ref_wape")))


_DECISION = """CASE WHEN quality < 70 THEN 'INVESTIGATE'
 WHEN status IN ('PERFORMANCE_DEGRADATION', 'HIGH_ERROR') AND features_with_drift > total_features * 0.3::DOUBLE THEN 'URGENT_RETRAIN'
 WHEN status IN ('PERFORMANCE_DEGRADATION', 'HIGH_ERROR') THEN 'RETRAIN'
 WHEN status = 'HIGH_BIAS' OR features_with_drift > total_features * 0.3::DOUBLE THEN 'MONITOR' ELSE 'NO_ACTION' END"""

# One series in seven has no registered model.
_HAS_MODEL = "(CAST(substr(product_id, 7) AS INTEGER) + length(store_id)) % 7 <> 0"


def _has_model():
    return (F.substring("product_id", 7, 9).cast("int") + F.length("store_id")) % 7 != 0


def health(spark, folder) -> DataFrame:
    dense, scan = panel_and_scan(spark, folder)
    dense = materialise(features.promotion_features(dense), "panel")
    champions, pairs = served(dense)
    models = champions.where(_has_model()).withColumn("registered_at", F.lit(datetime(2002, 1, 1)))
    quality = anomaly.quality(anomaly.detect(scan))
    return flows.health_reports(rounded(features.engineer(dense), 6), pairs, models, quality, dates=dense)


part(
    "judged",
    "performed drifted",
    f"""
SELECT p.* EXCLUDE (status, degradation), d.* EXCLUDE (store_id, product_id), m,
       CASE WHEN m THEN degradation ELSE 0 END AS degradation,
       CASE WHEN m AND degradation > 0.2::DOUBLE THEN 'PERFORMANCE_DEGRADATION' WHEN wape > 0.15::DOUBLE THEN 'HIGH_ERROR'
            WHEN abs(bias) / (mean_a + 1e-5::DOUBLE) > 0.1::DOUBLE THEN 'HIGH_BIAS' ELSE 'HEALTHY' END AS status
FROM (SELECT *, {_HAS_MODEL} AS m FROM performed) p JOIN drifted d ON p.store_id = d.store_id AND p.product_id = d.product_id
""",
)
part(
    "reports",
    "judged best quality",
    f"""
SELECT e.store_id, e.product_id, CASE WHEN m THEN e.store_id || '_' || e.product_id || '_' || model_type || '_v1' ELSE 'None' END AS production_model,
       CASE WHEN NOT m THEN 'ARCHIVED/MISSING' WHEN e.status = 'HEALTHY' THEN 'HEALTHY' ELSE 'DEGRADED' END AS model_status,
       quality AS data_quality_score, CASE WHEN m THEN total_features ELSE 0 END AS total_features,
       CAST(CASE WHEN m THEN features_with_drift ELSE 0 END AS BIGINT) AS features_with_drift,
       CASE WHEN m THEN percentage_drifted ELSE 0 END AS percentage_drifted,
       CASE WHEN m THEN highest_drift_feature ELSE 'None' END AS highest_drift_feature,
       {_FIGURES}, e.status AS performance_status, CASE WHEN NOT m THEN 'URGENT_RETRAIN' ELSE {_DECISION} END AS retraining_decision,
       CASE WHEN m THEN 0 ELSE 1 END AS problem_products, CASE WHEN m THEN '2002-01-01 00:00:00' ELSE 'Never' END AS last_training_date
FROM judged e JOIN (SELECT store_id AS s, product_id AS p, model_type FROM best) ON s = e.store_id AND p = e.product_id
CROSS JOIN (SELECT data_quality_score AS quality FROM quality)
""",
)


@entry("d06_d07_health", query("reports", "SELECT * FROM reports"))
def _(spark, folder):
    reports = health(spark, folder)
    return reports.select(
        *[c for c in reports.columns if c not in ("drift", "performance")],
        "drift.*",
        *[F.col(f"performance.{c}").alias(c) for c in ("wape", "mae", "rmse", "bias", "residual_mean", "residual_std", "degradation")],
        F.col("performance.status").alias("performance_status"),
    )


@entry(
    "d08_decision",
    query(
        "performed drifted series_quality",
        f"""
SELECT p.store_id, p.product_id, quality, p.status AS performance_status, {_DECISION.replace('status', 'p.status')} AS decision
FROM performed p JOIN drifted d ON p.store_id = d.store_id AND p.product_id = d.product_id
JOIN (SELECT store_id AS s, product_id AS x, data_quality_score AS quality FROM series_quality) ON s = p.store_id AND x = p.product_id
""",
    ),
)
def _(spark, folder):
    """Each series decided with its own quality score."""
    dense, scan = panel_and_scan(spark, folder)
    dense = materialise(features.promotion_features(dense), "panel")
    champions, pairs = served(dense)
    error = monitor.performance(pairs, champions.select(*SERIES, (F.col("wape") / 100).alias("ref_wape")))
    quality = anomaly.quality(anomaly.detect(scan), SERIES)
    rows = (
        error.join(monitor.drift_summary(drift_of_written(dense)), SERIES)
        .join(quality.select(*SERIES, F.col("data_quality_score").alias("quality")), SERIES)
        .withColumnRenamed("status", "performance_status")
    )
    choice = monitor.decision(
        F.col("quality"), F.col("performance_status"), F.col("total_features"), F.col("features_with_drift")
    )
    return rows.select(*SERIES, "quality", "performance_status", choice.alias("decision"))


@entry(
    "d09_promote",
    query(
        "scores best serving",
        """
SELECT b.store_id, b.product_id, b.wape AS candidate_wape, coalesce(s.wape, 0) AS reference_wape,
       coalesce(s.wape, 0) = 0 OR coalesce((s.wape - b.wape) / s.wape >= 0.02::DOUBLE, false) AS promote
FROM best b JOIN serving v ON b.store_id = v.store_id AND b.product_id = v.product_id
LEFT JOIN scores s ON s.store_id = b.store_id AND s.product_id = b.product_id AND s.model_type = v.champion_type
""",
    ),
)
def _(spark, folder):
    scores = materialise(
        selection.score_candidates(flows.learn_and_score(features.promotion_features(materialise(panel(spark, folder), "panel")))), "scores"
    )
    held = serving(scores).join(scores.select(*SERIES, "model_type", F.col("wape").alias("reference_wape")), [*SERIES, "model_type"], "left")
    rows = selection.best(scores).select(*SERIES, F.col("wape").alias("candidate_wape")).join(held, SERIES)
    return rows.select(
        *SERIES,
        "candidate_wape",
        F.coalesce("reference_wape", F.lit(0.0)).alias("reference_wape"),
        monitor.promote(F.col("reference_wape"), F.col("candidate_wape")).alias("promote"),
    )


@entry(
    "d10_retrain_gate",
    query(
        "reports",
        """
, asked AS (SELECT 'lst_' || o_orderkey AS request_id, CASE WHEN o_orderkey % 10 = 0 THEN 'ATLANTIS' ELSE r_name END AS store_id,
                   'Brand#' || (1 + o_orderkey % 25) AS product_id
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT a.*, CASE WHEN d IS NULL THEN 'NOT_FOUND' WHEN d IN ('NO_ACTION', 'MONITOR') THEN 'REJECTED' ELSE 'ACCEPTED' END AS status,
       CASE WHEN d IS NULL THEN 'Cannot decide retraining, no report exists.' WHEN d IN ('NO_ACTION', 'MONITOR') THEN 'Decision was ' || d || '. System is healthy.'
            ELSE 'Retraining triggered for ' || a.product_id || '.' END AS message
FROM asked a LEFT JOIN (SELECT store_id, product_id, retraining_decision AS d FROM reports) r ON a.store_id = r.store_id AND a.product_id = r.product_id
""",
    ),
)
def _(spark, folder):
    """One request per order; one in ten names a store without reports."""
    offers = retail.listings(spark, folder)
    order = F.substring("id", 5, 20).cast("bigint")
    asked = offers.select(
        F.col("id").alias("request_id"),
        F.when(order % 10 == 0, "ATLANTIS").otherwise(F.col("seller_store_id")).alias("store_id"),
        "product_id",
    )
    return monitor.retrain_gate(asked, health(spark, folder))


# --- registry -------------------------------------------------------------------------------

part(
    "reg",
    "",
    """
SELECT 'store_' || user_id % 7 AS store_id, 'item_' || user_id AS product_id, 'v' || event_id AS version_id, event_id AS seq,
       CASE WHEN event_type IN ('error', 'click') THEN 'ROLLBACK' ELSE 'REGISTER' END AS event, ts AS at
FROM events
""",
)
part(
    "piled",
    "reg",
    """
SELECT *, x + greatest(0, 1 - min(x) OVER (PARTITION BY store_id, product_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS height
FROM (SELECT r.*, sum(CASE event WHEN 'REGISTER' THEN 1 ELSE -1 END) OVER (PARTITION BY r.store_id, r.product_id ORDER BY r.seq) AS x
      FROM reg r JOIN (SELECT store_id, product_id, min(seq) AS first_seq FROM reg WHERE event = 'REGISTER' GROUP BY ALL) f
        ON r.store_id = f.store_id AND r.product_id = f.product_id AND r.seq >= f.first_seq)
""",
)
part(
    "known_versions",
    "piled",
    """
SELECT p.store_id, p.product_id, p.version_id, p.seq,
       CASE WHEN coalesce(later < height, false) THEN 'ROLLED_BACK' WHEN height = final THEN 'PRODUCTION' ELSE 'ARCHIVED' END AS status
FROM (SELECT *, min(height) OVER (PARTITION BY store_id, product_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later,
             last_value(height) OVER (PARTITION BY store_id, product_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
      FROM piled) p WHERE event = 'REGISTER'
""",
)


part("reg_v", "", PARTS["reg"] + " WHERE event_type <> 'view'")
part("piled_v", "reg_v", re.sub(r"\breg\b", "reg_v", PARTS["piled"]))
part(
    "asked_v",
    "piled_v",
    """
SELECT a.*, 'v' || l.live AS version_id
FROM (SELECT 'store_' || user_id % 7 AS store_id, 'item_' || user_id AS product_id, event_id AS seq, value AS actual,
             value * (1 + (event_id % 9 - 3) / 23) AS forecast FROM events WHERE event_type = 'view') a
ASOF LEFT JOIN (SELECT store_id, product_id, seq, max(CASE event WHEN 'REGISTER' THEN seq END) OVER (PARTITION BY store_id, product_id, height ORDER BY seq) AS live
                FROM piled_v) l
ON a.store_id = l.store_id AND a.product_id = l.product_id AND a.seq >= l.seq
""",
)


def charged(spark, folder) -> DataFrame:
    events = materialise(retail.registry_events(spark, folder, views=False), "registry")
    return registry.serving(retail.served_requests(spark, folder), events)


@entry("g02_version_as_of", query("asked_v", "SELECT store_id, product_id, seq, version_id FROM asked_v"))
def _(spark, folder):
    """The version that was in production when each request came; versions come, go and return."""
    return charged(spark, folder).select(*SERIES, "seq", "version_id")


@entry(
    "d04_errors_by_version",
    query(
        "asked_v",
        """
SELECT store_id, product_id, version_id, n, round_even(wape, 4) + 0.0 AS wape, round_even(mae, 4) + 0.0 AS mae, round_even(bias, 4) + 0.0 AS bias,
       CASE WHEN wape > 0.15::DOUBLE THEN 'HIGH_ERROR' WHEN abs(bias) / (mean_a + 1e-5::DOUBLE) > 0.1::DOUBLE THEN 'HIGH_BIAS' ELSE 'HEALTHY' END AS status
FROM (SELECT store_id, product_id, version_id, count(*) AS n, avg(a - f) AS bias, avg(abs(a - f)) AS mae, avg(a) AS mean_a,
             CASE WHEN sum(a) > 0 THEN sum(abs(a - f)) / sum(a) ELSE avg(abs(a - f)) END AS wape
      FROM (SELECT *, greatest(actual, 0) AS a, greatest(forecast, 0) AS f FROM asked_v) GROUP BY store_id, product_id, version_id)
""",
    ),
)
def _(spark, folder):
    """Errors charged to the version that served them."""
    rows, by = charged(spark, folder), [*SERIES, "version_id"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    found = monitor.performance(rows, by=by).select(*by, "wape", "mae", "bias", "status")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    return found.alias("x").join(sizes.alias("y"), same).select("x.*", "y.n")


@entry("g01_versions", query("known_versions", "SELECT * FROM known_versions"))
def _(spark, folder):
    return registry.versions(retail.registry_events(spark, folder)).drop("at")


@entry(
    "g02_production",
    query("known_versions", "SELECT * EXCLUDE (status) FROM known_versions WHERE status = 'PRODUCTION'"),
)
def _(spark, folder):
    return registry.production(retail.registry_events(spark, folder)).drop("at")


@entry(
    "g03_rollback",
    query(
        "known_versions",
        """
SELECT store_id, product_id, 'v' || max(seq) AS version_id, max(seq) AS seq FROM known_versions
WHERE status = 'ARCHIVED' OR (status = 'PRODUCTION' AND NOT EXISTS (SELECT 1 FROM known_versions k WHERE k.status = 'ARCHIVED'
      AND k.store_id = known_versions.store_id AND k.product_id = known_versions.product_id))
GROUP BY store_id, product_id
""",
    ),
)
def _(spark, folder):
    """Roll every series back once: the newest archived version goes live where there is one."""
    events = retail.registry_events(spark, folder)
    wanted = events.groupBy(*SERIES).agg((F.max("at") + F.expr("INTERVAL 1 DAY")).alias("at"), (F.max("seq") + 1).alias("seq"))
    return registry.production(events.unionByName(registry.rollback(events, wanted))).drop("at")
