"""Sources, validation, cleaning, features, anomalies and overview."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.catalog import Entry, plain, rounded
from shelfcast.catalog.sql import NEEDS, PARTS, part, query, r
from shelfcast.functions.keys import SERIES
from shelfcast.functions.quantiles import group_quantiles
from shelfcast.operators import anomaly, clean, distinct, features, overview, validate
from shelfcast.plans.increments import PanelState
from shelfcast.plans.prepare import daily_table, prepared, sales_panel
from shelfcast.session import materialise
from shelfcast.sources import reports, retail, sales
from shelfcast.streaming.sources import scratch

AS_OF = date(2000, 1, 1)
ENTRIES: dict[str, Entry] = {}


def entry(name: str, sql: str | None = None):
    def add(run):
        ENTRIES[name] = Entry(lambda spark, folder: plain(run(spark, folder)), sql)
        return run

    return add


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return sales_panel(retail.sales(spark, folder), scope="global")


# --- sources --------------------------------------------------------------------------------


@entry(
    "s01_scan_csv",
    query(
        "raw",
        f"""
SELECT store_id AS "Location", count(*) AS n, sum(sales) AS quantity, count(DISTINCT date) AS days, {r("max(price)")} AS top_price
FROM raw GROUP BY store_id
""",
    ),
)
def _(spark, folder):
    path = scratch(spark, "csv")
    retail.sales_headers(spark, folder).write.option("header", True).csv(path)
    read = sales.scan_sales(spark, path)
    return read.groupBy("Location").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("Quantity").try_cast("double")).alias("quantity"),
        F.countDistinct("Date").alias("days"),
        F.round(F.max(F.col("Unit_Price").try_cast("double")), 4).alias("top_price"),
    )


@entry(
    "s02_normalise_columns",
    query("raw", f"SELECT date, store_id, category, product_id, {r('price')} AS price, sales, disc AS \"Discount_Applied\" FROM raw"),
)
def _(spark, folder):
    return rounded(sales.normalise_columns(retail.sales_headers(spark, folder)))


@entry(
    "s03_recent_slice",
    query(
        "raw",
        """
SELECT store_id, product_id, date, count(*) AS n, sum(sales) AS sales FROM raw
WHERE date >= (SELECT max(date) FROM raw) - 60 GROUP BY store_id, product_id, date
""",
    ),
)
def _(spark, folder):
    recent = sales.recent_slice(retail.sales(spark, folder), 60)
    return recent.groupBy(*SERIES, "date").agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("sales"))


_SERIES_REPORT = "SELECT store_id, product_id, count(*) AS days, sum(sales) AS sales, max(date) AS last_date FROM days GROUP BY store_id, product_id"


def _series_reports(spark, folder) -> DataFrame:
    return (
        clean.daily(retail.sales(spark, folder))
        .groupBy(*SERIES)
        .agg(F.count(F.lit(1)).alias("days"), F.sum("sales").alias("sales"), F.max("date").alias("last_date"))
    )


@entry("s04_write_reports", query("days", _SERIES_REPORT))
def _(spark, folder):
    path = scratch(spark, "reports")
    made = _series_reports(spark, folder)
    reports.write_reports(made, path)
    return spark.read.schema(made.schema).json(path).select(*made.columns)


@entry(
    "s05_reference_snapshot",
    query(
        "dense labels",
        """
SELECT store_id, product_id, count(*) AS days, sum(sales) AS sales, min(d.date) AS first_date
FROM dense d JOIN labels USING (date) WHERE split = 'validation' GROUP BY store_id, product_id
""",
    ),
)
def _(spark, folder):
    path = scratch(spark, "reference")
    split = features.chronological_split(panel(spark, folder))
    reports.write_reference_snapshot(split.where(F.col("split") == "validation"), path)
    kept = reports.read_reference_snapshot(spark, path)
    return kept.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("days"), F.sum("sales").alias("sales"), F.min("date").alias("first_date")
    )


@entry(
    "s06_read_report",
    query("days", f"SELECT * FROM ({_SERIES_REPORT}) WHERE store_id = 'ASIA' AND product_id = 'Brand#7'"),
)
def _(spark, folder):
    path = scratch(spark, "reports")
    made = _series_reports(spark, folder)
    reports.write_reports(made, path)
    return reports.read_report(spark, path, made.schema, store_id="ASIA", product_id="Brand#7")


@entry("s07_list_stores", query("raw", "SELECT DISTINCT store_id FROM raw"))
def _(spark, folder):
    return sales.list_dimension(retail.sales(spark, folder), "store_id")


@entry("s07_list_products", query("fine", "SELECT DISTINCT product_id FROM fine"))
def _(spark, folder):
    return sales.list_dimension(retail.sales_fine(spark, folder), "product_id")


# --- validation -----------------------------------------------------------------------------


def faulty(spark, folder) -> DataFrame:
    """Line items as a text table with unparseable numbers and dates and missing values."""
    q, p = F.col("l_quantity"), F.col("l_partkey")
    return retail.table(spark, folder, "lineitem").select(
        F.when(p % 50 == 0, "not a date").when(p % 50 == 1, None).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("store_id"),
        p.cast("string").alias("product_id"),
        F.when(q == 13, "n/a").when(q == 14, None).otherwise(q.cast("int").cast("string")).alias("sales"),
        F.nullif("l_discount", F.lit(0.0)).alias("price"),
    )


_FAULTY = """
SELECT CASE WHEN l_partkey % 50 = 0 THEN 'not a date' WHEN l_partkey % 50 = 1 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
       'S' || l_suppkey AS store_id, CAST(l_partkey AS VARCHAR) AS product_id,
       CASE WHEN l_quantity = 13 THEN 'n/a' WHEN l_quantity = 14 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS sales,
       nullif(l_discount, 0) AS price
FROM lineitem
"""


def odd_sales(spark, folder) -> DataFrame:
    """Line items with returns (negative), zero and infinite sales, and a suspicious column."""
    k = F.col("l_orderkey")
    quantity = (
        F.when(k % 31 == 0, -F.col("l_quantity"))
        .when(k % 37 == 0, F.lit(0.0))
        .when(k % 997 == 5, F.lit(float("inf")))
        .otherwise(F.col("l_quantity"))
    )
    return retail.table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_suppkey").cast("string").alias("product_id"),
        quantity.alias("sales"),
        F.col("l_tax").alias("target_tax"),
    )


_ODD = """
SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS product_id,
       CASE WHEN l_orderkey % 31 = 0 THEN -l_quantity WHEN l_orderkey % 37 = 0 THEN 0
            WHEN l_orderkey % 997 = 5 THEN CAST('inf' AS DOUBLE) ELSE l_quantity END AS sales
FROM lineitem
"""


@entry(
    "v01_statistics",
    query(
        "fine",
        """
SELECT count(*) AS rows, count(DISTINCT product_id) AS products, count(DISTINCT store_id) AS stores,
       min(date) AS first_date, max(date) AS last_date FROM fine
""",
    ),
)
def _(spark, folder):
    return validate.statistics(retail.sales_fine(spark, folder))


@entry(
    "v04_single_store",
    query(
        "",
        """
SELECT 'single_store' AS "check", 'INFO' AS severity, 'dataset' AS scope, 1 AS n, 'Dataset contains only one store' AS message
FROM (SELECT count(DISTINCT 'web') AS s FROM events) WHERE s = 1
""",
    ),
)
def _(spark, folder):
    """All events belong to one shop."""
    events = retail.table(spark, folder, "events")
    return validate.check_single_store(events.withColumn("store_id", F.lit("web")))


@entry(
    "v06_v07_types",
    f"""
WITH t AS ({_FAULTY}), c AS (
SELECT count_if(sales IS NOT NULL AND try_cast(sales AS DOUBLE) IS NULL) AS s,
       count_if(date IS NOT NULL AND try_cast(date AS DATE) IS NULL) AS d FROM t)
SELECT 'sales_numeric' AS "check", 'ERROR' AS severity, 'dataset' AS scope, CAST(s AS BIGINT) AS n, 'Sales column is not numeric.' AS message FROM c WHERE s > 0
UNION ALL SELECT 'date_format', 'WARNING', 'dataset', CAST(d AS BIGINT), 'Date column contains unparseable values.' FROM c WHERE d > 0
""",
)
def _(spark, folder):
    return validate.check_types(faulty(spark, folder))


_MISSING_SQL = f"""
WITH t AS ({_FAULTY}), c AS (
SELECT count(*) AS total, count_if(try_cast(date AS DATE) IS NULL) AS d, count_if(sales IS NULL) AS s, count_if(price IS NULL) AS p FROM t),
u AS (SELECT 'date' AS col, d AS n, total FROM c UNION ALL SELECT 'sales', s, total FROM c UNION ALL SELECT 'price', p, total FROM c)
SELECT 'missing_values' AS "check", 'WARNING' AS severity, col AS scope, CAST(n AS BIGINT) AS n,
       'Column ''' || col || ''' has ' || CAST(n AS BIGINT) || ' missing values (' || format('{{:.2f}}', n / total * 100) || '%).' AS message
FROM u WHERE n > 0
"""


@entry("v08_missing", _MISSING_SQL)
def _(spark, folder):
    return validate.check_missing(faulty(spark, folder))


@entry(
    "v09_exact_duplicates",
    """
SELECT 'exact_duplicates' AS "check", 'WARNING' AS severity, 'dataset' AS scope, CAST(n AS BIGINT) AS n,
       'Found ' || CAST(n AS BIGINT) || ' exact duplicate rows.' AS message
FROM (SELECT sum(c - 1) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_suppkey, l_quantity, l_returnflag)) WHERE n > 0
""",
)
def _(spark, folder):
    return validate.check_exact_duplicates(retail.table(spark, folder, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag"))


@entry(
    "v10_key_duplicates",
    query(
        "raw",
        """
SELECT 'key_duplicates' AS "check", 'WARNING' AS severity, 'dataset' AS scope, CAST(n AS BIGINT) AS n,
       'Found ' || CAST(n AS BIGINT) || ' duplicate rows based on (date, product_id, store_id).' AS message
FROM (SELECT sum(c - 1) AS n FROM (SELECT count(*) AS c FROM raw GROUP BY date, product_id, store_id)) WHERE n > 0
""",
    ),
)
def _(spark, folder):
    return validate.check_key_duplicates(retail.sales(spark, folder))


@entry(
    "v11_v14_values",
    f"""
WITH t AS ({_ODD}), c AS (
SELECT count_if(date > DATE '2000-01-01') AS fut, count_if(sales < 0) AS neg, count_if(sales = 0) AS zero, count_if(isinf(sales)) AS inf FROM t)
SELECT 'future_dates' AS "check", 'WARNING' AS severity, 'dataset' AS scope, CAST(fut AS BIGINT) AS n, 'Found ' || CAST(fut AS BIGINT) || ' rows with future dates.' AS message FROM c
UNION ALL SELECT 'negative_sales', 'WARNING', 'dataset', CAST(neg AS BIGINT), 'Found ' || CAST(neg AS BIGINT) || ' rows with negative sales. May represent returns.' FROM c
UNION ALL SELECT 'zero_sales', 'INFO', 'dataset', CAST(zero AS BIGINT), 'Found ' || CAST(zero AS BIGINT) || ' rows with zero sales.' FROM c
UNION ALL SELECT 'infinite_sales', 'WARNING', 'dataset', CAST(inf AS BIGINT), 'Found infinite values in sales.' FROM c
""",
)
def _(spark, folder):
    return validate.check_values(odd_sales(spark, folder), AS_OF)


@entry(
    "v15_spikes",
    query(
        "raw",
        """
SELECT CAST(coalesce(sum(CASE WHEN l_tax_units > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n
FROM (SELECT l_suppkey, l_quantity * l_quantity * l_quantity AS l_tax_units FROM lineitem)
JOIN (SELECT l_suppkey, quantile_cont(l_quantity * l_quantity * l_quantity, 0.25) AS q1,
             quantile_cont(l_quantity * l_quantity * l_quantity, 0.75) AS q3
      FROM lineitem GROUP BY l_suppkey HAVING count(*) > 3) USING (l_suppkey)
""",
    ),
)
def _(spark, folder):
    cubed = F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")
    rows = retail.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("product_id"), cubed.alias("sales"))
    return validate.sales_spikes(rows)


_HISTORY_SQL = """
SELECT product_id, store_id, count(*) AS records, max(date) - min(date) + 1 AS expected_days, count(DISTINCT date) AS days FROM fine GROUP BY ALL
"""


@entry(
    "v16_v17_history",
    query(
        "fine",
        f"""
SELECT 'short_history' AS "check", 'WARNING' AS severity, product_id || '-' || store_id AS scope, records AS n,
       'Insufficient history for ' || product_id || '-' || store_id || ': ' || records || ' records (Min: 30). Status: INSUFFICIENT_DATA' AS message
FROM ({_HISTORY_SQL}) WHERE records < 30
UNION ALL
SELECT 'missing_dates', 'WARNING', product_id || '-' || store_id, expected_days - days,
       'Item ' || product_id || '-' || store_id || ' has ' || (expected_days - days) || ' missing dates ('
       || format('{{:.2f}}', (expected_days - days) / expected_days * 100) || '% missing rate).'
FROM ({_HISTORY_SQL}) WHERE records > 1 AND (expected_days - days) / expected_days * 100 > 10
""",
    ),
)
def _(spark, folder):
    return validate.check_history(retail.sales_fine(spark, folder), 30)


@entry(
    "v17_series_history",
    query(
        "fine",
        f"""
SELECT *, expected_days - days AS missing_days, {r("(expected_days - days) / expected_days * 100")} AS missing_percent FROM ({_HISTORY_SQL})
""",
    ),
)
def _(spark, folder):
    return rounded(validate.series_history(retail.sales_fine(spark, folder)))


@entry(
    "v19_verdict",
    f"""
WITH t AS ({_ODD}), d AS (SELECT sum(c - 1) AS e FROM (SELECT count(*) AS c FROM lineitem GROUP BY CAST(l_shipdate AS DATE), l_suppkey,
   CASE WHEN l_orderkey % 31 = 0 THEN -l_quantity WHEN l_orderkey % 37 = 0 THEN 0 WHEN l_orderkey % 997 = 5 THEN CAST('inf' AS DOUBLE) ELSE l_quantity END, l_tax)),
k AS (SELECT sum(c - 1) AS e FROM (SELECT count(*) AS c FROM t GROUP BY date, product_id)),
v AS (SELECT count_if(date > DATE '2000-01-01') AS fut, count_if(sales < 0) AS neg, count_if(sales = 0) AS zero, count_if(isinf(sales)) AS inf FROM t),
f AS (SELECT product_id, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3 FROM t GROUP BY product_id HAVING count(*) > 3),
o AS (SELECT count_if(sales > q3 + 1.5 * (q3 - q1)) AS n FROM t JOIN f USING (product_id)),
h AS (SELECT product_id, count(*) AS records, max(date) - min(date) + 1 AS ex, count(DISTINCT date) AS dd FROM t GROUP BY product_id),
w AS (SELECT count_if(records < 30) + count_if(records > 1 AND (ex - dd) / ex * 100 > 10) AS n FROM h)
SELECT 'FAIL' AS status, 1 AS errors,
   CAST((d.e > 0)::INT + (k.e > 0)::INT + (fut > 0)::INT + (neg > 0)::INT + (inf > 0)::INT + (o.n > 0)::INT + w.n AS BIGINT) AS warnings,
   CAST(2 + (zero > 0)::INT AS BIGINT) AS infos
FROM d, k, v, o, w
""",
)
def _(spark, folder):
    findings = validate.validate(odd_sales(spark, folder), as_of=AS_OF)
    return validate.verdict(findings).drop("messages")


@entry(
    "v20_validate_gated",
    f"""
WITH t AS ({_FAULTY}), c AS (
SELECT count(*) AS total, count_if(sales IS NOT NULL AND try_cast(sales AS DOUBLE) IS NULL) AS bs, count_if(date IS NOT NULL AND try_cast(date AS DATE) IS NULL) AS bd,
       count_if(try_cast(date AS DATE) IS NULL) AS d, count_if(sales IS NULL) AS s, count_if(price IS NULL) AS p FROM t),
e AS (SELECT sum(n - 1) AS n FROM (SELECT count(*) AS n FROM t GROUP BY date, store_id, product_id, sales, price)),
k AS (SELECT sum(n - 1) AS n FROM (SELECT count(*) AS n FROM t GROUP BY date, product_id, store_id))
SELECT "check", severity, scope, CAST(n AS BIGINT) AS n FROM (
SELECT 'optional_columns' AS "check", 'INFO' AS severity, 'schema' AS scope, 2 AS n
UNION ALL SELECT 'promotion_column', 'INFO', 'schema', 1
UNION ALL SELECT 'sales_numeric', 'ERROR', 'dataset', bs FROM c
UNION ALL SELECT 'date_format', 'WARNING', 'dataset', bd FROM c
UNION ALL SELECT 'missing_values', 'WARNING', 'date', d FROM c
UNION ALL SELECT 'missing_values', 'WARNING', 'sales', s FROM c
UNION ALL SELECT 'missing_values', 'WARNING', 'price', p FROM c
UNION ALL SELECT 'exact_duplicates', 'WARNING', 'dataset', n FROM e
UNION ALL SELECT 'key_duplicates', 'WARNING', 'dataset', n FROM k) WHERE n > 0
""",
)
def _(spark, folder):
    """Sales that are no numbers hold back the checks on values."""
    return validate.validate(faulty(spark, folder), as_of=AS_OF).drop("message")


# --- cleaning -------------------------------------------------------------------------------


@entry(
    "p01_parse_dates",
    f"""
WITH t AS ({_FAULTY})
SELECT store_id, product_id, CAST(date AS DATE) AS date, coalesce(sum(try_cast(sales AS DOUBLE)), 0) AS sales,
       {r("coalesce(avg(price), 0)", 6)} AS price
FROM t WHERE try_cast(date AS DATE) IS NOT NULL GROUP BY ALL
""",
)
def _(spark, folder):
    days = clean.daily(faulty(spark, folder))
    return days.select(*SERIES, "date", "sales", F.round(F.coalesce("price", F.lit(0.0)), 6).alias("price"))


@entry(
    "p02_daily",
    query("days", f"SELECT * EXCLUDE (price), {r('price')} AS price FROM days"),
)
def _(spark, folder):
    return rounded(clean.daily(retail.sales(spark, folder)))


@entry(
    "p02_daily_by_category",
    query(
        "raw",
        f"""
SELECT store_id, product_id, date, category, coalesce(sum(sales), 0) AS sales, {r("avg(price)")} AS price,
       CASE WHEN max(disc) > 0 THEN 1 ELSE 0 END AS promotion, 20 AS safety_stock, 2 AS lead_time_days
FROM raw GROUP BY store_id, product_id, date, category
""",
    ),
)
def _(spark, folder):
    return rounded(clean.daily(retail.sales(spark, folder, category=True), by_category=True))


_GAPPY = """
SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS store_id, l_returnflag || l_linestatus AS product_id,
       l_quantity AS sales, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax * 100 + l_linenumber END AS price
FROM lineitem
"""


def gappy(spark, folder) -> DataFrame:
    """Line items by supplier and status, without a price where no tax was paid."""
    return retail.table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_suppkey").cast("string").alias("store_id"),
        F.concat("l_returnflag", "l_linestatus").alias("product_id"),
        F.col("l_quantity").alias("sales"),
        F.when(F.col("l_tax") != 0, F.col("l_tax") * 100 + F.col("l_linenumber")).alias("price"),
    )


@entry(
    "p07_fill_from_product",
    f"""
WITH t AS ({_GAPPY}), d AS (SELECT store_id, product_id, date, sum(sales) AS sales, avg(price) AS price FROM t GROUP BY ALL),
m AS (SELECT product_id, quantile_cont(price, 0.5) AS median FROM d GROUP BY product_id)
SELECT store_id, product_id, date, sales, {r("coalesce(price, median, 0)", 6)} AS price FROM d JOIN m USING (product_id)
""",
)
def _(spark, folder):
    filled = clean.fill_from_product(clean.daily(gappy(spark, folder)), "price")
    return rounded(filled.select(*SERIES, "date", "sales", "price"), 6)


@entry(
    "p07_product_quantiles",
    f"""
WITH t AS ({_GAPPY})
SELECT product_id, {r("quantile_cont(price, 0.1)")} AS p10, {r("quantile_cont(price, 0.5)")} AS p50, {r("quantile_cont(price, 0.9)")} AS p90
FROM t WHERE price IS NOT NULL GROUP BY product_id
""",
)
def _(spark, folder):
    """The way for groups of unlimited size, on every group."""
    q = group_quantiles(gappy(spark, folder), ["product_id"], "price", [0.1, 0.5, 0.9])
    return q.select("product_id", *[F.round(F.col("quantiles")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@entry("p08_outliers", query("cleaned", "SELECT store_id, product_id, date, sales, is_outlier FROM cleaned"))
def _(spark, folder):
    return clean.clean(retail.sales(spark, folder)).select(*SERIES, "date", "sales", "is_outlier")


@entry("p09_p13_dense_panel", query("dense", f"SELECT * EXCLUDE (price), {r('price')} AS price FROM dense"))
def _(spark, folder):
    return rounded(panel(spark, folder))


@entry(
    "p10_observed_scope",
    query(
        "fine",
        f"""
SELECT store_id, product_id, max(date) - min(date) + 1 AS days, CAST(count(DISTINCT date) AS BIGINT) AS days_with_sales, sum(sales) AS sales,
       min(date) AS first_date, max(date) AS last_date FROM fine GROUP BY store_id, product_id
""",
    ),
)
def _(spark, folder):
    dense = clean.densify(clean.daily(retail.sales_fine(spark, folder)), scope="observed")
    return dense.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("sales") > 0).alias("days_with_sales"),
        F.sum("sales").alias("sales"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


# --- features -------------------------------------------------------------------------------

_KEY = "store_id, product_id, date"


def _feature_columns(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select(*SERIES, "date", *names))


_CALENDAR = ["day_of_week", "day_of_month", "week_of_year", "month", "quarter", "day_of_year", "is_weekend"]
_CYCLES = ["sin_day_of_week", "cos_day_of_week", "sin_month", "cos_month"]
_ROLLING = [f"rolling_{s}_{n}" for n in (7, 28) for s in ("mean", "std", "min", "max")] + ["rolling_mean_14"]
_CHANGE = f"{r('price - previous_price')} AS price_change"
_CHANGE_PCT = f"{r('CASE WHEN previous_price = 0 THEN 0 ELSE (price - previous_price) / previous_price END')} AS price_change_pct"
_TREND = f"{r('CASE WHEN rolling_mean_28 = 0 THEN 0 ELSE rolling_mean_7 / rolling_mean_28 END')} AS trend_ratio"


def _r_all(names: list[str], digits: int = 4) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


@entry("f01_f02_calendar", query("featured", f"SELECT {_KEY}, {', '.join(_CALENDAR)}, {_r_all(_CYCLES)} FROM featured"))
def _(spark, folder):
    return _feature_columns(features.calendar_features(panel(spark, folder)), *_CALENDAR, *_CYCLES)


_FLAGS = ", ".join(f"CASE WHEN lag_{n} IS NULL THEN 0 ELSE 1 END AS has_lag_{n}" for n in features.LAGS)


@entry("f03_f04_lags", query("featured", f"SELECT {_KEY}, lag_1, lag_7, lag_14, lag_28, {_FLAGS} FROM featured"))
def _(spark, folder):
    names = [f"lag_{n}" for n in features.LAGS] + [f"has_lag_{n}" for n in features.LAGS]
    return _feature_columns(features.lag_features(panel(spark, folder)), *names)


@entry("f05_f06_rolling", query("featured", f"SELECT {_KEY}, {_r_all(_ROLLING)} FROM featured"))
def _(spark, folder):
    return _feature_columns(features.rolling_features(panel(spark, folder)), *_ROLLING)


@entry("f07_trend", query("featured", f"SELECT {_KEY}, {_TREND} FROM featured"))
def _(spark, folder):
    return _feature_columns(features.trend_features(features.rolling_features(panel(spark, folder))), "trend_ratio")


@entry("f08_promotion", query("featured", f"SELECT {_KEY}, is_promotion FROM featured"))
def _(spark, folder):
    return _feature_columns(features.promotion_features(panel(spark, folder)), "is_promotion")


@entry("f09_price", query("featured", f"SELECT {_KEY}, {r('previous_price')} AS previous_price, {_CHANGE}, {_CHANGE_PCT} FROM featured"))
def _(spark, folder):
    return _feature_columns(features.price_features(panel(spark, folder)), "previous_price", "price_change", "price_change_pct")


_STORES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@entry(
    "f10_one_hot",
    query(
        "days",
        "SELECT store_id, product_id, date, "
        + ", ".join(f"store_id = '{s}' AS \"store_id_{s.replace(' ', '_')}\"" for s in _STORES)
        + " FROM days",
    ),
)
def _(spark, folder):
    hot = features.one_hot(clean.daily(retail.sales(spark, folder)), {"store_id": _STORES})
    return hot.select(*SERIES, "date", *[F.col(f"store_id_{s}").alias(f"store_id_{s.replace(' ', '_')}") for s in _STORES])


_SEEN = (
    "promotion day_of_week day_of_month week_of_year month quarter day_of_year is_weekend sin_day_of_week cos_day_of_week sin_month "
    "cos_month lag_1 lag_7 lag_14 lag_28 has_lag_1 has_lag_7 has_lag_14 has_lag_28 rolling_mean_7 rolling_std_7 rolling_min_7 "
    "rolling_max_7 rolling_mean_14 rolling_mean_28 rolling_std_28 rolling_min_28 rolling_max_28 trend_ratio is_promotion "
    "previous_price price_change price_change_pct"
).split()
_PRESENT = " UNION ALL ".join(f"SELECT '{n}' AS feature, count({n}) AS present FROM f" for n in _SEEN)


@entry("f11_numeric_features", query("featured", f", f AS MATERIALIZED (SELECT *, {_FLAGS}, {_TREND}, {_CHANGE}, {_CHANGE_PCT} FROM featured) {_PRESENT}"))
def _(spark, folder):
    """The columns a model may see, with how many rows have them."""
    engineered = features.engineer(panel(spark, folder))
    names = features.numeric_features(engineered)
    pairs = [F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("present")) for n in names]
    return engineered.agg(*[F.count(n).alias(n) for n in names]).select(F.inline(F.array(*pairs)))


_NEW_NULLS = (
    " + ".join(f"(lag_{n} IS NULL)::INT" for n in features.LAGS)
    + " + "
    + " + ".join(f"({c} IS NULL)::INT" for c in _ROLLING)
    + " + (rolling_mean_7 IS NULL OR rolling_mean_28 IS NULL)::INT + (previous_price IS NULL)::INT * 3"
)


@entry(
    "f12_feature_report",
    query(
        "featured",
        f"""
SELECT 9 AS input_columns, 33 AS generated, 4 AS lag, 4 AS history_flags, 9 AS rolling, 11 AS calendar, 1 AS trend, 1 AS promotion, 3 AS price,
       CAST(sum({_NEW_NULLS}) AS BIGINT) AS missing_values, 0 AS infinite_values FROM featured
""",
    ),
)
def _(spark, folder):
    before = panel(spark, folder)
    return features.feature_report(before, features.engineer(before))


@entry(
    "f13_split",
    query(
        "dense labels",
        "SELECT split, count(*) AS n, count(DISTINCT d.date) AS dates, min(d.date) AS first_date, max(d.date) AS last_date FROM dense d JOIN labels USING (date) GROUP BY split",
    ),
)
def _(spark, folder):
    split = features.chronological_split(panel(spark, folder))
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("date").alias("dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


@entry(
    "f14_engineer",
    query(
        "featured",
        f"""
SELECT {_KEY}, sales, promotion, is_outlier, safety_stock, lead_time_days, {r('price')} AS price, {', '.join(_CALENDAR)}, {_r_all(_CYCLES)},
       lag_1, lag_7, lag_14, lag_28, {_FLAGS}, {_r_all(_ROLLING)}, {_TREND}, is_promotion,
       {r('previous_price')} AS previous_price, {_CHANGE}, {_CHANGE_PCT} FROM featured
""",
    ),
)
def _(spark, folder):
    return rounded(features.engineer(panel(spark, folder)))


_HISTORY = [f"lag_{n}" for n in features.LAGS] + [f"has_lag_{n}" for n in features.LAGS]


@entry(
    "f05_f06_sparse_history",
    query(
        "featured days",
        f"SELECT {_KEY}, lag_1, lag_7, lag_14, lag_28, {_FLAGS}, {_r_all(_ROLLING)}, {_TREND} FROM featured JOIN (SELECT {_KEY} FROM days) USING ({_KEY})",
    ),
)
def _(spark, folder):
    """Lags and rolling measures of the rows that exist, from range frames; no grid is made."""
    days = materialise(clean.daily(retail.sales(spark, folder)), "daily")
    first = days.agg(F.min("date")).scalar()
    return _feature_columns(features.sparse_history(days, first=first), *_HISTORY, *_ROLLING, "trend_ratio")


part(
    "observed",
    "dense days",
    """
SELECT d.* FROM dense d JOIN (SELECT store_id, product_id, min(date) AS lo, max(date) AS hi FROM days GROUP BY store_id, product_id) USING (store_id, product_id)
WHERE date BETWEEN lo AND hi
""",
)
part("featured_observed", "observed", PARTS["featured"].replace("FROM dense", "FROM observed"))
_PANEL_COLUMNS = ["sales", "promotion", "price", "safety_stock", "lead_time_days"]


@entry(
    "f14_increments",
    query(
        "featured_observed",
        f"""
SELECT {_KEY}, sales, promotion, {r('price')} AS price, safety_stock, lead_time_days, {', '.join(_CALENDAR)}, {_r_all(_CYCLES)},
       lag_1, lag_7, lag_14, lag_28, {_FLAGS}, {_r_all(_ROLLING)}, {_TREND}, is_promotion,
       {r('previous_price')} AS previous_price, {_CHANGE}, {_CHANGE_PCT}
FROM featured_observed WHERE date > (SELECT max(date) FROM days) - 10
""",
    ),
)
def _(spark, folder):
    """The last ten days in four runs on top of a kept state, instead of a rebuild of the panel."""
    days = materialise(clean.daily(retail.sales(spark, folder)).select(*SERIES, "date", *_PANEL_COLUMNS), "daily")
    end = days.agg(F.max("date")).first()[0]
    cut = end - timedelta(days=10)
    state = PanelState.start(clean.densify(days.where(F.col("date") <= F.lit(cut))))
    added = None
    for length in (1, 2, 3, 4):
        upto = cut + timedelta(days=length)
        run = days.where((F.col("date") > F.lit(cut)) & (F.col("date") <= F.lit(upto)))
        rows = materialise(state.rows(run), "increment")
        added = rows if added is None else added.unionByName(rows)
        following = state.after(run)
        state.drop()
        state, cut = following, upto
    state.drop()
    return rounded(added.where(F.col("date") > F.lit(end - timedelta(days=10))))


# --- anomalies ------------------------------------------------------------------------------

# Stock levels that swing, fall below zero and jump, from the date and the sales.
_STOCK_SQL = "CAST((CAST(date - DATE '1995-01-01' AS INTEGER) * 37 + CAST(sales AS INTEGER) * 11) % 1400 - 20 AS BIGINT)"


def scanned(spark, folder) -> DataFrame:
    return to_scan(daily_table(retail.sales(spark, folder)))


def panel_and_scan(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The dense panel and the rows to scan, from one reading of the sales."""
    days, dense = prepared(retail.sales(spark, folder), scope="global")
    return dense, to_scan(days)


def to_scan(days: DataFrame) -> DataFrame:
    day = F.datediff("date", F.lit(date(1995, 1, 1)))
    stock = (day * 37 + F.col("sales").cast("int") * 11) % 1400 - 20
    days = days.withColumn("price", F.round("price", 4)).withColumn("current_stock", stock.cast("bigint"))
    return features.promotion_features(features.calendar_features(days))


part(
    "scan",
    "cleaned",
    f"""
SELECT store_id, product_id, date, sales, round(price, 4) AS price, promotion AS is_promotion, isodow(date) - 1 AS day_of_week,
       {_STOCK_SQL} AS current_stock FROM cleaned
""",
)
part(
    "measured",
    "scan",
    """
SELECT *, avg(sales) OVER w7 AS rmean, coalesce(stddev_samp(sales) OVER w7, 1) AS rstd,
       lag(price) OVER w AS price_before, lag(current_stock) OVER w AS stock_before
FROM scan WINDOW w AS (PARTITION BY store_id, product_id ORDER BY date),
                 w7 AS (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""",
)
part(
    "bounded",
    "measured fences",
    """
SELECT m.*, (q3 + 1.5 * (q3 - q1)) * CASE WHEN is_promotion > 0 THEN 2 ELSE 1 END
            * CASE WHEN day_of_week >= 5 THEN CAST(1.2 AS DOUBLE) ELSE 1 END AS bound,
       CASE WHEN rstd = 0 THEN 0 ELSE abs((sales - rmean) / rstd) END AS z
FROM measured m JOIN fences USING (store_id, product_id)
""",
)
part(
    "compared",
    "bounded",
    "SELECT *, sales > bound OR z > 3 AS spike, least(1, sales / (bound + CAST(1e-5 AS DOUBLE))) AS ratio FROM bounded",
)
part(
    "flagged",
    "compared",
    """
SELECT *, CASE
  WHEN sales = 0 AND rmean > 10 THEN {'t': 'DEMAND_DROP', 's': 'MEDIUM', 'v': CAST(0.8 AS DOUBLE), 'r': 'Sudden 0-demand drop against high rolling average.'}
  WHEN current_stock < 0 THEN {'t': 'CRITICAL_DATA_ERROR', 's': 'CRITICAL', 'v': CAST(1 AS DOUBLE), 'r': 'Impossible negative inventory value.'}
  WHEN price <= 0 THEN {'t': 'CRITICAL_DATA_ERROR', 's': 'CRITICAL', 'v': CAST(1 AS DOUBLE), 'r': 'Impossible negative or zero price value.'}
  WHEN spike AND is_promotion = 0 AND ratio > CAST(0.9 AS DOUBLE) THEN {'t': 'DEMAND_SPIKE', 's': 'HIGH', 'v': round_even(ratio, 2), 'r': 'Unexplained demand spike (' || sales || ') exceeds context boundaries.'}
  WHEN current_stock > stock_before + 1000 THEN {'t': 'INVENTORY_JUMP', 's': 'HIGH', 'v': CAST(0.8 AS DOUBLE), 'r': 'Massive unexplained inventory increase.'}
  WHEN price_before > 0 AND (price / price_before > 2 OR price / price_before < CAST(0.2 AS DOUBLE)) THEN {'t': 'PRICE_ANOMALY', 's': 'HIGH', 'v': CAST(0.9 AS DOUBLE), 'r': 'Massive price variation (' || price_before || ' -> ' || price || ').'}
  WHEN spike AND is_promotion = 0 THEN {'t': 'DEMAND_SPIKE', 's': 'MEDIUM', 'v': round_even(ratio, 2), 'r': 'Unexplained demand spike (' || sales || ') exceeds context boundaries.'}
  WHEN spike THEN {'t': 'BUSINESS_EVENT', 's': 'LOW', 'v': CAST(0.4 AS DOUBLE), 'r': 'High demand aligns with active promotion context.'}
  ELSE {'t': 'NORMAL', 's': 'NONE', 'v': CAST(0 AS DOUBLE), 'r': ''} END AS f
FROM compared
""",
)


@entry(
    "a02_demand_bounds",
    query("fences", f"SELECT store_id, product_id, {r('q3 + 1.5 * (q3 - q1)')} AS base_upper FROM fences"),
)
def _(spark, folder):
    return rounded(anomaly.demand_bounds(clean.daily(retail.sales(spark, folder))))


@entry(
    "a03_a04_measures",
    query(
        "bounded",
        f"SELECT {_KEY}, {r('bound')} AS bound, {r('rmean')} AS rolling_mean, {r('rstd')} AS rolling_std, {r('z')} AS z FROM bounded",
    ),
)
def _(spark, folder):
    m = anomaly.measures(scanned(spark, folder))
    return rounded(
        m.select(
            *SERIES,
            "date",
            F.col("_bound").alias("bound"),
            F.col("_mean").alias("rolling_mean"),
            F.col("_std").alias("rolling_std"),
            F.coalesce("_z", F.lit(0.0)).alias("z"),
        )
    )


@entry(
    "a01_a13_detect",
    query(
        "flagged",
        f"""
SELECT {_KEY}, sales, f.s <> 'NONE' AS is_anomaly, f.v AS anomaly_score, f.t AS anomaly_type,
       f.s AS anomaly_severity, f.r AS anomaly_reason FROM flagged
""",
    ),
)
def _(spark, folder):
    return anomaly.detect(scanned(spark, folder)).select(*SERIES, "date", "sales", *anomaly.FLAG_COLUMNS)


_COUNTS = """CAST(count(*) AS BIGINT) AS total_records, CAST(count_if(f.s <> 'NONE') AS BIGINT) AS anomalies,
 CAST(count_if(f.s = 'CRITICAL') AS BIGINT) AS critical, CAST(count_if(f.s = 'HIGH') AS BIGINT) AS high,
 CAST(count_if(f.s = 'MEDIUM') AS BIGINT) AS medium, CAST(count_if(f.s = 'LOW') AS BIGINT) AS low"""
_SCORE = "greatest(0, 100 - (critical + CAST(0.8 AS DOUBLE) * high + CAST(0.3 AS DOUBLE) * medium + CAST(0.05 AS DOUBLE) * low) / total_records * 100)"
_STATUS = "CASE WHEN score < 70 THEN 'CRITICAL' WHEN score < 90 OR critical > 0 THEN 'WARNING' ELSE 'HEALTHY' END"
part(
    "quality",
    "flagged",
    f"SELECT * EXCLUDE (score), {_STATUS} AS status, round_even(score, 2) AS data_quality_score FROM (SELECT *, {_SCORE} AS score FROM (SELECT {_COUNTS} FROM flagged))",
)
part(
    "series_quality",
    "flagged",
    f"""
SELECT * EXCLUDE (score), {_STATUS} AS status, round_even(score, 2) AS data_quality_score
FROM (SELECT *, {_SCORE} AS score FROM (SELECT store_id, product_id, {_COUNTS} FROM flagged GROUP BY store_id, product_id))
""",
)
part(
    "found",
    "flagged",
    """
SELECT store_id, product_id, strftime(date, '%Y-%m-%d') AS date, f.t AS anomaly_type, f.s AS severity, f.v AS score, f.r AS reason,
       sales AS original_value FROM flagged WHERE f.s <> 'NONE'
""",
)


@entry("q01_q02_q04_quality", query("quality", "SELECT * FROM quality"))
def _(spark, folder):
    return anomaly.quality(anomaly.detect(scanned(spark, folder)))


@entry("q03_quality_by_series", query("series_quality", "SELECT * FROM series_quality"))
def _(spark, folder):
    return anomaly.quality(anomaly.detect(scanned(spark, folder)), SERIES)


@entry(
    "q01_q03_levels",
    query(
        "flagged",
        f"""
SELECT * EXCLUDE (score, g), CASE g WHEN 0 THEN 'series' WHEN 1 THEN 'store' ELSE 'all' END AS level, {_STATUS} AS status,
       round_even(score, 2) AS data_quality_score
FROM (SELECT *, {_SCORE} AS score FROM (SELECT store_id, product_id, GROUPING(store_id, product_id) AS g, {_COUNTS} FROM flagged GROUP BY ROLLUP (store_id, product_id)))
""",
    ),
)
def _(spark, folder):
    """Quality of all series, all stores and the table in one rollup."""
    return anomaly.quality_levels(anomaly.detect(scanned(spark, folder)))


@entry("q05_records", query("found", "SELECT * FROM found"))
def _(spark, folder):
    return anomaly.records(anomaly.detect(scanned(spark, folder)))


@entry(
    "q06_page",
    query("found", "SELECT * FROM found WHERE store_id = 'EUROPE' ORDER BY store_id, product_id, date LIMIT 50 OFFSET 100"),
)
def _(spark, folder):
    return anomaly.page(anomaly.records(anomaly.detect(scanned(spark, folder))), page=3, page_size=50, store_id="EUROPE")


@entry(
    "q06_page_totals",
    query(
        "found",
        "SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM found WHERE store_id = 'EUROPE'",
    ),
)
def _(spark, folder):
    return anomaly.page_totals(anomaly.records(anomaly.detect(scanned(spark, folder))), page_size=50, store_id="EUROPE")


# The scan as a training run sees it where every third day's sales are missing.
_GAPS = "CAST(date - DATE '1990-01-01' AS INTEGER) % 3 = 0"
part(
    "m_scan",
    "raw",
    f"""
SELECT store_id, product_id, date, sales, round(price, 4) AS price, is_promotion, isodow(date) - 1 AS day_of_week, {_STOCK_SQL} AS current_stock
FROM (SELECT store_id, product_id, date, sum(CASE WHEN {_GAPS} THEN NULL ELSE sales END) AS sales, avg(price) AS price,
             CASE WHEN max(disc) > 0 THEN 1 ELSE 0 END AS is_promotion FROM raw GROUP BY store_id, product_id, date)
""",
)
part(
    "m_fences",
    "m_scan",
    """
SELECT store_id, product_id, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3
FROM m_scan GROUP BY store_id, product_id
""",
)


def copied_parts(prefix: str, names: tuple[str, ...]) -> None:
    """The scan's parts over another table of rows, in which sales may be missing."""
    for name in names:
        sql = re.sub(r"\b(FROM|JOIN) (?=[a-z])", rf"\1 {prefix}", PARTS[name]).replace(
            "WHEN sales = 0 AND rmean > 10",
            "WHEN sales IS NULL THEN {'t': 'MISSING_DATA', 's': 'CRITICAL', 'v': CAST(1 AS DOUBLE), 'r': 'Missing sales record.'}\n  WHEN sales = 0 AND rmean > 10",
        )
        part(f"{prefix}{name}", " ".join(f"{prefix}{n}" for n in NEEDS[name]), sql)


copied_parts("m_", ("measured", "bounded", "compared", "flagged"))


def with_gaps(spark, folder) -> DataFrame:
    raw = retail.sales(spark, folder)
    gone = F.datediff("date", F.lit(date(1990, 1, 1))) % 3 == 0
    return raw.withColumn("sales", F.when(~gone, F.col("sales")))


@entry(
    "a02_a05_missing_in_flow",
    query(
        "m_flagged",
        f"""
SELECT {_KEY}, sales, {r('bound')} AS bound, f.s <> 'NONE' AS is_anomaly, f.v AS anomaly_score, f.t AS anomaly_type,
       f.s AS anomaly_severity, f.r AS anomaly_reason FROM m_flagged
""",
    ),
)
def _(spark, folder):
    """Rows with missing sales through the plan of a training run: they neither lower the fence nor the means."""
    days, _ = prepared(with_gaps(spark, folder))
    scan = to_scan(days)
    bounds = anomaly.measures(scan).select(*SERIES, "date", F.round("_bound", 4).alias("bound"))
    return anomaly.detect(scan).select(*SERIES, "date", "sales", *anomaly.FLAG_COLUMNS).join(bounds, [*SERIES, "date"])


# The same over steadier sales in which every finding occurs.  Days and series are those of
# the sales table; values follow from day and brand number, with an event every few days.
_EVENT_SQL = """
SELECT store_id, product_id, date, k % 5 AS calm, CASE WHEN k % 5 = 0 OR (k % 5 = 1 AND e > 1) THEN 96 ELSE e END AS e, base, price FROM (
  SELECT store_id, product_id, date, k, (dn * 31 + k * 17) % 97 AS e, 40 + (dn * 13 + k) % 9 AS base, 10 + k % 3 AS price FROM (
    SELECT store_id, product_id, date, CAST(date - DATE '1990-01-01' AS INTEGER) AS dn,
           CAST(substr(product_id, 7) AS INTEGER) + length(store_id) AS k FROM days))
"""
part("y_events", "days", _EVENT_SQL)
part(
    "y_scan",
    "y_events",
    """
SELECT store_id, product_id, date,
       CAST(CASE WHEN e IN (0, 1, 8) THEN base * 30 WHEN e IN (2, 9) THEN 0 WHEN e = 3 THEN NULL ELSE base END AS DOUBLE) AS sales,
       CAST(CASE WHEN e IN (4, 9) THEN 0 WHEN e = 5 THEN price * 5 ELSE price END AS DOUBLE) AS price,
       CASE WHEN e = 1 THEN 1 ELSE 0 END AS is_promotion, isodow(date) - 1 AS day_of_week,
       CAST(CASE WHEN e IN (6, 8) THEN -5 WHEN e = 7 THEN 3000 ELSE 500 END AS BIGINT) AS current_stock
FROM y_events
""",
)
part(
    "y_fences",
    "y_scan",
    """
SELECT store_id, product_id, quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.75) AS q3
FROM y_scan GROUP BY store_id, product_id
""",
)
copied_parts("y_", ("measured", "bounded", "compared", "flagged", "series_quality"))


def steady(spark, folder) -> DataFrame:
    days = clean.daily(retail.sales(spark, folder)).select(*SERIES, "date")
    dn = F.datediff("date", F.lit(date(1990, 1, 1)))
    k = F.substring("product_id", 7, 9).cast("int") + F.length("store_id")
    e = (dn * 31 + k * 17) % 97
    days = days.select(*SERIES, "date", dn.alias("dn"), k.alias("k"), F.when((k % 5 == 0) | ((k % 5 == 1) & (e > 1)), 96).otherwise(e).alias("e"))
    base, price, e = 40 + (F.col("dn") * 13 + F.col("k")) % 9, 10 + F.col("k") % 3, F.col("e")
    sales = F.when(e.isin(0, 1, 8), base * 30).when(e.isin(2, 9), 0).when(e == 3, F.lit(None)).otherwise(base)
    rows = days.select(
        *SERIES,
        "date",
        sales.cast("double").alias("sales"),
        F.when(e.isin(4, 9), 0).when(e == 5, price * 5).otherwise(price).cast("double").alias("price"),
        (e == 1).cast("int").alias("promotion"),
        F.when(e.isin(6, 8), -5).when(e == 7, 3000).otherwise(500).cast("bigint").alias("current_stock"),
    )
    return features.promotion_features(features.calendar_features(rows))


@entry(
    "a05_a13_steady_detect",
    query(
        "y_flagged",
        f"""
SELECT {_KEY}, sales, f.s <> 'NONE' AS is_anomaly, f.v AS anomaly_score, f.t AS anomaly_type,
       f.s AS anomaly_severity, f.r AS anomaly_reason FROM y_flagged
""",
    ),
)
def _(spark, folder):
    return anomaly.detect(steady(spark, folder)).select(*SERIES, "date", "sales", *anomaly.FLAG_COLUMNS)


@entry(
    "a14_finding_counts",
    query("y_flagged", "SELECT f.t AS anomaly_type, f.s AS anomaly_severity, f.r LIKE '%price%' AS about_price, count(*) AS n FROM y_flagged GROUP BY ALL"),
)
def _(spark, folder):
    """Rows per finding; every finding of the rules occurs."""
    flags = anomaly.detect(steady(spark, folder))
    return flags.groupBy("anomaly_type", "anomaly_severity", F.col("anomaly_reason").contains("price").alias("about_price")).agg(F.count(F.lit(1)).alias("n"))


@entry("q03_steady_quality", query("y_series_quality", "SELECT * FROM y_series_quality"))
def _(spark, folder):
    return anomaly.quality(anomaly.detect(steady(spark, folder)), SERIES)


@entry("q04_status_counts", query("y_series_quality", "SELECT status, count(*) AS series FROM y_series_quality GROUP BY status"))
def _(spark, folder):
    return anomaly.quality(anomaly.detect(steady(spark, folder)), SERIES).groupBy("status").agg(F.count(F.lit(1)).alias("series"))


# --- overview -------------------------------------------------------------------------------

_QUARTER = (date(1999, 4, 1), date(1999, 6, 30))


@entry(
    "b03_sketched_distinct",
    query(
        "fine",
        f"""
SELECT store_id, count(*) AS rows, count(DISTINCT product_id) AS products, count(DISTINCT date) AS dates, true AS products_within, true AS dates_within
FROM (SELECT (CAST(store_id AS INTEGER) % 3) AS store_id, product_id, date FROM fine) WHERE date BETWEEN '{_QUARTER[0]}' AND '{_QUARTER[1]}' GROUP BY store_id
""",
    ),
)
def _(spark, folder):
    """Distinct products and days of a quarter from the days' sketches, beside the exact counts: are they within the stated error?"""
    rows = retail.sales_fine(spark, folder).withColumn("store_id", F.col("store_id").cast("int") % 3)
    kept = materialise(distinct.daily_sketches(rows, {"products": "product_id", "dates": "date"}, by=["store_id"]), "distinct")
    told = distinct.distinct_between(kept, ["products", "dates"], first=_QUARTER[0], last=_QUARTER[1], by=["store_id"])
    exact = (
        rows.where(F.col("date").between(*_QUARTER))
        .groupBy("store_id")
        .agg(F.countDistinct("product_id").alias("_products"), F.countDistinct("date").alias("_dates"))
    )
    off = {n: F.abs(F.col(n) - F.col(f"_{n}")) <= F.col(f"_{n}") * distinct.relative_error() for n in ("products", "dates")}
    return told.join(exact, "store_id").select(
        "store_id",
        "rows",
        F.col("_products").alias("products"),
        F.col("_dates").alias("dates"),
        *[c.alias(f"{n}_within") for n, c in off.items()],
    )


@entry(
    "b01_recent_totals",
    query(
        "raw",
        "SELECT CAST(sum(sales) AS BIGINT) AS total_sales, count(DISTINCT product_id) AS active_products FROM raw WHERE date >= (SELECT max(date) FROM raw) - 60",
    ),
)
def _(spark, folder):
    return overview.recent_totals(retail.sales(spark, folder))


@entry(
    "b02_history",
    query("days", "SELECT date, sales FROM days WHERE store_id = 'ASIA' AND product_id = 'Brand#7'"),
)
def _(spark, folder):
    return overview.history(clean.daily(retail.sales(spark, folder)), store_id="ASIA", product_id="Brand#7")


@entry(
    "b03_dimension_counts",
    query("fine", "SELECT count(DISTINCT store_id) AS stores, count(DISTINCT product_id) AS products FROM fine"),
)
def _(spark, folder):
    return overview.dimension_counts(retail.sales_fine(spark, folder))


@entry("b04_first_records", query("found", "SELECT * FROM found ORDER BY store_id, product_id, date LIMIT 4"))
def _(spark, folder):
    return overview.first_records(anomaly.records(anomaly.detect(scanned(spark, folder))))


@entry(
    "b05_profile",
    query(
        "days",
        f"""
SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT store_id) AS stores, count(DISTINCT product_id) AS products,
       {r('avg(sales)')} AS mean_sales, sum(sales) AS total_sales, {r('sum(promotion) / count(*) * 100')} AS promotion_percent FROM days
""",
    ),
)
def _(spark, folder):
    return rounded(overview.profile(clean.daily(retail.sales(spark, folder))))
