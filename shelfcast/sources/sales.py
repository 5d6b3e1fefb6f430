"""Reading sales tables and cutting slices from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Header names of known layouts and the column they stand for.
ALIASES = {
    "Date": "date",
    "Location": "store_id",
    "Product_Category": "category",
    "Product_Name": "product_id",
    "Unit_Price": "price",
    "Quantity": "sales",
    "units_sold": "sales",
}


def scan_sales(spark: SparkSession, path: str, *, schema: StructType | None = None, fmt: str = "csv") -> DataFrame:
    """Read a sales table with whatever columns it has.

    A CSV without a schema is read as strings (one look at the header, no
    inference pass); validation counts what does not parse and cleaning casts.
    """
    if fmt != "csv":
        reader = spark.read.format(fmt)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename known headers (exact spelling) to the standard names."""
    names = [ALIASES.get(c, c) for c in df.columns]
    lowered = [n.lower() for n in names]
    clashes = sorted({n for n in names if lowered.count(n.lower()) > 1})
    if clashes:
        raise ValueError(f"several columns would be called {clashes}")
    return df.toDF(*names)


def recent_slice(df: DataFrame, days: int = 60, *, date: str = "date") -> DataFrame:
    """Rows of the last ``days`` days before the newest date, that date included."""
    newest = df.agg(F.max(date)).scalar()
    return df.where(F.col(date) >= F.date_sub(newest, days))


def list_dimension(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
