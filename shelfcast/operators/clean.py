"""From raw sales rows to a gap-free daily panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from shelfcast.functions.keys import SERIES, by_date, by_series, whole_series
from shelfcast.functions.numeric import no_nan
from shelfcast.functions.quantiles import group_quantiles
from shelfcast.functions.skew import all_pairs_of, skew_join
from shelfcast.operators.validate import _as_date, _as_number
from shelfcast.sources.sales import normalise_columns

# Defaults of columns the table does not have.
DEFAULTS = {"safety_stock": 20, "lead_time_days": 2, "price": 10.0}
DEFAULT_STORE = "DEFAULT_STORE"
OUTLIER_MULTIPLIER = 1.5

CARRIED = ["category", "price", "safety_stock", "lead_time_days"]


def daily(df: DataFrame, *, by_category: bool = False, carry_supplied: bool = True, keep_missing: bool = False) -> DataFrame:
    """One row per series and day.

    Unparseable dates and null keys are dropped.  With ``carry_supplied`` a
    supplied promotion, safety stock or lead time survives as its daily maximum;
    without it the defaults replace them.  ``keep_missing`` adds ``sales_missing``, true on
    days without any known sale, for the anomaly scan.  The aggregate combines before the
    shuffle and its key holds the day, so long series spread out.
    """
    df = normalise_columns(df)
    if "store_id" not in df.columns:
        df = df.withColumn("store_id", F.lit(DEFAULT_STORE))
    keys = [*SERIES, "date"] + (["category"] if by_category and "category" in df.columns else [])
    typed = df.withColumn("date", _as_date(df))
    aggs = [F.coalesce(F.sum(no_nan(_as_number(df, "sales"))), F.lit(0.0)).alias("sales")]
    if "price" in df.columns:
        aggs.append(F.avg(no_nan(_as_number(df, "price"))).alias("price"))
    if "category" in df.columns and not by_category:
        aggs.append(F.min("category").alias("category"))
    supplied = [c for c in ("promotion", "safety_stock", "lead_time_days") if c in df.columns and carry_supplied]
    # Texts become numbers first: the largest of '9' and '10' is 10, and 'n/a' counts as missing.
    aggs += [F.max(c if isinstance(df.schema[c].dataType, NumericType) else _as_number(df, c)).alias(c) for c in supplied]
    if "Discount_Applied" in df.columns:
        aggs.append(F.max(no_nan(_as_number(df, "Discount_Applied"))).alias("Discount_Applied"))
    if keep_missing:
        # A day whose sales are all missing, which the sum turns into 0.
        aggs.append((F.count(no_nan(_as_number(df, "sales"))) == 0).alias("sales_missing"))
    out = typed.dropna(subset=keys).groupBy(*keys).agg(*aggs)

    if "promotion" not in out.columns:
        on_offer = F.coalesce((F.col("Discount_Applied") > 0).cast("int"), F.lit(0))
        out = out.withColumn("promotion", on_offer if "Discount_Applied" in out.columns else F.lit(0))
    for column, value in DEFAULTS.items():
        if column not in out.columns:
            out = out.withColumn(column, F.lit(value))
    return out.drop("Discount_Applied")


def fill_from_product(panel: DataFrame, column: str) -> DataFrame:
    """Nulls become the product's median over all stores, then 0."""
    medians = group_quantiles(panel, ["product_id"], column, [0.5]).select(
        "product_id", F.col("quantiles")[0].alias("_median")
    )
    return (
        skew_join(panel, medians, ["product_id"], spread=["store_id", "date"], how="left")
        .withColumn(column, F.coalesce(column, "_median", F.lit(0.0)))
        .select(*panel.columns)
    )


def flag_outliers(panel: DataFrame) -> DataFrame:
    """``is_outlier``: sales above the upper IQR fence of the series."""
    q = F.percentile("sales", F.array(F.lit(0.25), F.lit(0.75))).over(whole_series())
    return (
        panel.withColumn("_q", q)
        .withColumn(
            "is_outlier",
            (F.col("sales") > F.col("_q")[1] + OUTLIER_MULTIPLIER * (F.col("_q")[1] - F.col("_q")[0])).cast("int"),
        )
        .drop("_q")
    )


def clean(df: DataFrame, *, by_category: bool = False, carry_supplied: bool = True) -> DataFrame:
    supplied = set(normalise_columns(df).columns)
    panel = daily(df, by_category=by_category, carry_supplied=carry_supplied)
    if "price" in supplied:
        panel = fill_from_product(panel, "price")
    if "promotion" in supplied and carry_supplied:
        panel = fill_from_product(panel, "promotion")
    return flag_outliers(panel)


def densify(
    panel: DataFrame, *, scope: str = "observed", extent: DataFrame | None = None, flag: bool = False, placed: bool = False
) -> DataFrame:
    """A row for every day of every series.

    ``observed``: only pairs that occur, each over its own range.
    ``global``: every store with every product over the whole date range; that is stores x
    products x days, for tables of few stores and products.

    Each row grows into itself plus the empty days up to the next row of its
    series, so the calendar is never joined or shuffled: the sparse rows move
    once, to their series, and the dense rows are made where they stay.  For the
    global grid one marker row per pair at the first date starts the calendar.
    ``extent`` may name a cheaper frame with the same stores, products and dates;
    ``flag`` adds the outlier flag of the real rows on the way.  ``placed`` rows lie with
    their series already and are not shuffled.
    """
    if scope not in ("global", "observed"):
        raise ValueError(f"unknown scope {scope!r}")
    rows = panel.withColumn("_real", F.lit(1))
    last = F.col("date")
    if scope == "global":
        extent = panel if extent is None else extent
        span = extent.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
        stores = extent.select("store_id").distinct()
        products = extent.select("product_id").distinct()
        starts = all_pairs_of(stores, products, "product_id").select(*SERIES, span["lo"].alias("date"), F.lit(0).alias("_real"))
        rows = rows.unionByName(starts, allowMissingColumns=True)
        last = span["hi"]

    if not placed:
        rows = by_series(rows)
    if flag:
        rows = flag_outliers(rows)
    tie = ["_real"] + (["category"] if "category" in panel.columns else [])
    order = by_date(*tie)
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    anywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = [c for c in CARRIED if c in panel.columns]
    until = F.coalesce(F.lead("date").over(order), F.date_add(last, 1))
    rows = rows.withColumns(
        {
            "_gap": F.datediff(until, F.col("date")),
            # With nothing known before a row, the next known value is the first of the series.
            **{c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(anywhere)) for c in carried},
        }
    )
    days = F.when(F.col("_real") == 1, F.greatest(F.col("_gap"), F.lit(1))).otherwise(F.col("_gap"))
    dense = rows.where(days > 0).withColumn("_day", F.explode(F.sequence(F.lit(0), days - 1)))
    here = (F.col("_real") == 1) & (F.col("_day") == 0)
    zeroed = [c for c in ("sales", "promotion", "is_outlier") if c in rows.columns]
    return dense.select(
        *SERIES,
        F.date_add("date", F.col("_day")).alias("date"),
        *[F.when(here, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast(rows.schema[c].dataType).alias(c) for c in zeroed],
        *[c for c in panel.columns if c in carried],
        *[
            F.when(here, F.col(c)).alias(c)
            for c in panel.columns
            if c not in (*SERIES, "date", *zeroed, *carried)
        ],
    )
