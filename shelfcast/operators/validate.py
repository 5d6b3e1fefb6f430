"""Checks on a raw sales table.

Every check is a DataFrame ``(check, severity, scope, n, message)``; a check that
finds nothing gives no rows.  Counting checks share one aggregate; the others use
aggregates with map-side combine, so a series holding a large part of the rows is
never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from shelfcast.functions.quantiles import group_quantiles
from shelfcast.functions.skew import skew_join
from shelfcast.session import materialise
from shelfcast.sources.sales import normalise_columns

# Columns a sales table must have, and may have.
REQUIRED_COLUMNS = ["date", "product_id", "sales"]
OPTIONAL_COLUMNS = ["store_id", "price", "promotion", "category"]
SUSPICIOUS_WORDS = ["future", "target", "test"]
MISSING_DATE_PERCENT = 10
OUTLIER_MULTIPLIER = 1.5
OUTLIER_MIN_VALUES = 4

# Date formats besides ISO, each with the shape of the texts it is tried on: month first.
DATE_FORMATS = (
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("M/d/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
)

CHECK_COLUMNS = "check string, severity string, scope string, n bigint, message string"
_RANK = {"ERROR": 3, "WARNING": 2, "INFO": 1}


def _key(df: DataFrame) -> list[str]:
    return ["product_id", "store_id"] if "store_id" in df.columns else ["product_id"]


def _finding(check: str, severity: str, n: Column, *message: str | Column, scope: Column | None = None) -> Column:
    parts = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(severity).alias("severity"),
        (F.lit("dataset") if scope is None else scope).alias("scope"),
        n.cast("bigint").alias("n"),
        F.concat(*parts).alias("message"),
    )


def _percent(n: Column, total: Column) -> Column:
    return F.format_string("%.2f", F.coalesce(F.try_divide(n, total), F.lit(0.0)) * 100)


def _rows(one_row: DataFrame, findings: Sequence[Column]) -> DataFrame:
    """Findings with a positive count, one row each."""
    if not findings:
        return one_row.sparkSession.createDataFrame([], CHECK_COLUMNS)
    return one_row.select(F.inline(F.array(*findings))).where(F.col("n") > 0)


def _as_number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, NumericType):
        return F.col(column).cast("double")
    return F.col(column).cast("string").try_cast("double")


def _as_date(df: DataFrame, column: str = "date", formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The day of a date, a timestamp or a text; texts are ISO or in the first of ``formats`` that fits."""
    kind = df.schema[column].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.col(column).cast("date")
    text = F.trim(F.col(column).cast("string"))
    tried = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in formats]
    return F.to_date(F.coalesce(F.try_to_timestamp(text), *tried))


def _is_missing(df: DataFrame, column: str) -> Column:
    col = F.col(f"`{column}`")
    kind = df.schema[column].dataType.typeName()
    return col.isNull() | F.isnan(col) if kind in ("double", "float") else col.isNull()


# --- V1 ---------------------------------------------------------------------------------


def statistics(df: DataFrame) -> DataFrame:
    """Rows, distinct products and stores, first and last date."""
    stores = F.countDistinct("store_id") if "store_id" in df.columns else F.lit(0).cast("bigint")
    return df.withColumn("_d", _as_date(df)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("product_id").alias("products"),
        stores.alias("stores"),
        F.min("_d").alias("first_date"),
        F.max("_d").alias("last_date"),
    )


# --- checks on the schema alone: V2, V3, V5, V18 ------------------------------------------


def check_schema(df: DataFrame) -> DataFrame:
    has = set(df.columns)
    found = []
    missing = [c for c in REQUIRED_COLUMNS if c not in has]
    if missing:
        found.append(("required_columns", "ERROR", "schema", len(missing), f"Missing required columns: {', '.join(missing)}"))
    else:
        absent = [c for c in OPTIONAL_COLUMNS if c not in has]
        if absent:
            found.append(("optional_columns", "INFO", "schema", len(absent), f"Missing optional columns: {', '.join(absent)}"))
        if not has & {"promotion", "Discount_Applied"}:
            found.append(("promotion_column", "INFO", "schema", 1, "No promotions column available"))
    return df.sparkSession.createDataFrame(found, CHECK_COLUMNS)


def check_leakage(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if any(w in c.lower() for w in SUSPICIOUS_WORDS) and c not in ("sales", "category")]
    found = (
        [("leakage", "ERROR", "schema", len(names), f"Potential data leakage in raw data. Suspicious columns: {', '.join(names)}")]
        if names
        else []
    )
    return df.sparkSession.createDataFrame(found, CHECK_COLUMNS)


# --- counting checks ---------------------------------------------------------------------


# Checks that count over all rows: what they aggregate, and their findings on that one row.
Counting = tuple[list[Column], list[Column]]


def _checked(df: DataFrame, counting: Counting) -> DataFrame:
    counts, found = counting
    return _rows(df.agg(*counts), found) if counts else df.sparkSession.createDataFrame([], CHECK_COLUMNS)


def _single_store(df: DataFrame) -> Counting:
    if "store_id" not in df.columns:
        return [], []
    # The least and greatest store tell one from several without keeping them all.
    one = (F.col("_store_lo") == F.col("_store_hi")).cast("int")
    counts = [F.min("store_id").alias("_store_lo"), F.max("store_id").alias("_store_hi")]
    return counts, [_finding("single_store", "INFO", one, "Dataset contains only one store")]


def check_single_store(df: DataFrame) -> DataFrame:
    """V4"""
    return _checked(df, _single_store(df))


def _types(df: DataFrame) -> Counting:
    counts, found = [], []
    for column, label in (("sales", "Sales"), ("price", "Price")):
        if column in df.columns and not isinstance(df.schema[column].dataType, NumericType):
            bad = F.col(column).isNotNull() & _as_number(df, column).isNull()
            counts.append(F.count_if(bad).alias(f"_{column}"))
            found.append(_finding(f"{column}_numeric", "ERROR", F.col(f"_{column}"), f"{label} column is not numeric."))
    if isinstance(df.schema["date"].dataType, StringType):
        counts.append(F.count_if(F.col("date").isNotNull() & _as_date(df).isNull()).alias("_date"))
        counts.append(F.count(_as_date(df)).alias("_dates"))
        found.append(_finding("date_format", "WARNING", F.col("_date"), "Date column contains unparseable values."))
        none = F.when((F.col("_dates") == 0) & (F.col("_date") > 0), F.col("_date"))
        found.append(_finding("no_dates", "ERROR", none, "Date column has no readable date."))
    return counts, found


def check_types(df: DataFrame) -> DataFrame:
    """V6 and V7: values that are no numbers or dates; a date column without any date is an error.

    Typed columns cannot fail, so only string columns are looked at.
    """
    return _checked(df, _types(df))


def _missing_counts(df: DataFrame) -> list[Column]:
    counts = [
        F.count_if(_as_date(df).isNull() if c == "date" else _is_missing(df, c)).alias(f"_m{i}")
        for i, c in enumerate(df.columns)
    ]
    return [F.count(F.lit(1)).alias("_total"), *counts]


def missing_values(df: DataFrame) -> DataFrame:
    """Missing values of every column, dates counted after parsing: ``(column, n, total)``."""
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n"), F.col("_total").alias("total")) for i, c in enumerate(df.columns)
    ]
    return df.agg(*_missing_counts(df)).select(F.inline(F.array(*pairs)))


def _missing(df: DataFrame) -> Counting:
    found = [
        _finding(
            "missing_values",
            "WARNING",
            F.col(f"_m{i}"),
            f"Column '{c}' has ",
            F.col(f"_m{i}"),
            " missing values (",
            _percent(F.col(f"_m{i}"), F.col("_total")),
            "%).",
            scope=F.lit(c),
        )
        for i, c in enumerate(df.columns)
    ]
    return _missing_counts(df), found


def check_missing(df: DataFrame) -> DataFrame:
    """V8"""
    return _checked(df, _missing(df))


def copies(df: DataFrame) -> DataFrame:
    """Distinct rows with how often each occurs (``_c``): what V9 and V10 count on."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))


def _extra(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("n"))


def check_exact_duplicates(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """V9; ``rows`` takes the result of ``copies`` where several checks share it (nulls equal nulls)."""
    one = _extra(copies(df) if rows is None else rows)
    return _rows(one, [_finding("exact_duplicates", "WARNING", F.col("n"), "Found ", F.col("n"), " exact duplicate rows.")])


def counted(df: DataFrame) -> DataFrame:
    """Rows per series, day (``_d``) and sales (``_v``): what V15 to V17 count on."""
    number = _as_number(df, "sales")
    day = _as_date(df) if "date" in df.columns else F.lit(None).cast("date")
    cells = df.select(*_key(df), day.alias("_d"), F.when(~F.isnan(number), number).alias("_v"))
    return cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("_c"))


def check_key_duplicates(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """V10; ``rows`` as in V9."""
    keys = ["date", "product_id"] + (["store_id"] if "store_id" in df.columns else [])
    label = f" duplicate rows based on ({', '.join(keys)})."
    rows = df.withColumn("_c", F.lit(1).cast("bigint")) if rows is None else rows
    one = _extra(rows.groupBy(*[k for k in keys if k in df.columns]).agg(F.sum("_c").alias("_c")))
    return _rows(one, [_finding("key_duplicates", "WARNING", F.col("n"), "Found ", F.col("n"), label)])


def _values(df: DataFrame, as_of: date) -> Counting:
    sales = _as_number(df, "sales")
    counts = [
        F.count_if(_as_date(df) > F.lit(as_of)).alias("future"),
        F.count_if((sales < 0) & ~F.isnan(sales)).alias("negative"),
        F.count_if(sales == 0).alias("zero"),
        F.count_if(F.abs(sales) == F.lit(float("inf"))).alias("infinite"),
    ]
    return (
        counts,
        [
            _finding("future_dates", "WARNING", F.col("future"), "Found ", F.col("future"), " rows with future dates."),
            _finding(
                "negative_sales",
                "WARNING",
                F.col("negative"),
                "Found ",
                F.col("negative"),
                " rows with negative sales. May represent returns.",
            ),
            _finding("zero_sales", "INFO", F.col("zero"), "Found ", F.col("zero"), " rows with zero sales."),
            _finding("infinite_sales", "WARNING", F.col("infinite"), "Found infinite values in sales."),
        ],
    )


def check_values(df: DataFrame, as_of: date) -> DataFrame:
    """V11 to V14 in one pass: future dates, negative, zero and infinite sales."""
    return _checked(df, _values(df, as_of))


def sales_spikes(df: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Rows above the upper IQR fence of their series, as one count.

    Works on ``(series, value)`` counts: the rows of a series shrink to its
    distinct values before they meet the fence.
    """
    keys = _key(df)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    number = _as_number(df, "sales")
    rows = df.where(known).select(*keys, F.when(~F.isnan(number), number).alias("_v")).where(F.col("_v").isNotNull())
    cells = counted(df) if cells is None else cells
    counts = cells.where(known & F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.sum("_c").alias("_n"))
    enough = counts.groupBy(*keys).agg(F.sum("_n").alias("_m")).where(F.col("_m") >= OUTLIER_MIN_VALUES)
    fence = (
        group_quantiles(rows, keys, "_v", [0.25, 0.75], counts=counts)
        .join(enough, keys)
        .select(
            *keys,
            (F.col("quantiles")[1] + OUTLIER_MULTIPLIER * (F.col("quantiles")[1] - F.col("quantiles")[0])).alias("_upper"),
        )
    )
    above = F.when(F.col("_v") > F.col("_upper"), F.col("_n")).otherwise(0)
    return skew_join(counts, fence, keys, spread=["_v"]).agg(F.coalesce(F.sum(above), F.lit(0)).cast("bigint").alias("n"))


def check_spikes(df: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    return _rows(
        sales_spikes(df, cells),
        [
            _finding(
                "sales_spikes",
                "WARNING",
                F.col("n"),
                "Found ",
                F.col("n"),
                " potential demand outliers (spikes) using IQR method.",
            )
        ],
    )


def series_history(df: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Per series: records, expected days, missing days and their percentage."""
    keys = _key(df)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # Days are counted in two steps (series and day, then series): a long series
    # reaches the second step as one row per day.
    cells = counted(df) if cells is None else cells
    daily = cells.where(known).groupBy(*keys, "_d").agg(F.sum("_c").alias("_c"))
    spans = daily.groupBy(*keys).agg(
        F.sum("_c").alias("records"),
        (F.datediff(F.max("_d"), F.min("_d")) + 1).cast("bigint").alias("expected_days"),
        F.count("_d").alias("days"),
    )
    missing = F.col("expected_days") - F.col("days")
    return spans.withColumn("missing_days", missing).withColumn(
        "missing_percent", F.try_divide(missing, F.col("expected_days")) * 100
    )


def check_history(df: DataFrame, min_history: int, cells: DataFrame | None = None) -> DataFrame:
    """Short series and series with many days missing."""
    name = F.concat_ws("-", *_key(df))
    short = _finding(
        "short_history",
        "WARNING",
        F.when(F.col("records") < min_history, F.col("records")),
        "Insufficient history for ",
        name,
        ": ",
        F.col("records"),
        f" records (Min: {min_history}). Status: INSUFFICIENT_DATA",
        scope=name,
    )
    gaps = _finding(
        "missing_dates",
        "WARNING",
        F.when((F.col("records") > 1) & (F.col("missing_percent") > MISSING_DATE_PERCENT), F.col("missing_days")),
        "Item ",
        name,
        " has ",
        F.col("missing_days"),
        " missing dates (",
        _percent(F.col("missing_days"), F.col("expected_days")),
        "% missing rate).",
        scope=name,
    )
    return series_history(df, cells).select(F.inline(F.array(short, gaps))).where(F.col("n").isNotNull())


# --- all together -------------------------------------------------------------------------


def validate(df: DataFrame, *, min_history: int = 30, as_of: date) -> DataFrame:
    """All findings on a raw table.

    A missing required column ends the checks (V2).  When sales or price do not
    parse as numbers, the checks on their values are held back (V20): the gate is one row, read
    before any of them is prepared.  All counting checks share one aggregate over the rows, written
    once, the gate included; both counts of duplicates share one shuffle of the distinct rows; the
    checks on series read the counted cells, written once.
    """
    df = normalise_columns(df)
    schema = check_schema(df)
    if any(c not in df.columns for c in REQUIRED_COLUMNS):
        return schema
    plain = [_single_store(df), _types(df), _missing(df)]
    values = _values(df, as_of)
    one = materialise(df.agg(*[c for counts, _ in [*plain, values] for c in counts]), "counts")
    # A check of values counts only if no text failed to be a number.
    open_ = reduce(lambda x, y: x & y, [F.col(f"_{c}") == 0 for c in _untyped(df)], F.lit(True))
    gated = [f.withField("n", F.when(open_, f["n"])) for f in values[1]]
    rows = copies(df)
    found = [schema, _rows(one, [f for _, found in plain for f in found] + gated), check_exact_duplicates(df, rows), check_key_duplicates(df, rows)]
    if one.select(open_.alias("open")).first()["open"]:
        cells = materialise(counted(df), "cells")
        found += [check_spikes(df, cells), check_history(df, min_history, cells), check_leakage(df)]
    return reduce(DataFrame.unionByName, found)


def _untyped(df: DataFrame) -> list[str]:
    return [c for c in ("sales", "price") if c in df.columns and not isinstance(df.schema[c].dataType, NumericType)]


def verdict(findings: DataFrame) -> DataFrame:
    """PASS, WARNING or FAIL, with counts and one message per kind of check.

    A check on series can have a finding per series, so the roll-up lists each
    check once with its number of findings; the findings table has them all.
    """
    rank = F.create_map(*[F.lit(x) for pair in _RANK.items() for x in pair])
    per_check = findings.groupBy("check", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.min("message").alias("message")
    )
    return per_check.agg(
        F.when(F.max(F.element_at(rank, F.col("severity"))) == 3, "FAIL")
        .when(F.max(F.element_at(rank, F.col("severity"))) == 2, "WARNING")
        .otherwise("PASS")
        .alias("status"),
        *[
            F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("findings"))), F.lit(0)).cast("bigint").alias(n)
            for s, n in (("ERROR", "errors"), ("WARNING", "warnings"), ("INFO", "infos"))
        ],
        F.array_sort(
            F.collect_list(F.concat(F.col("check"), F.lit(" x"), F.col("findings").cast("string"), F.lit(": "), F.col("message")))
        ).alias("messages"),
    )
