"""The star-schema tables seen as the inputs of the operators.

``sales_headers`` presents line items as a sales table with shop-style headers;
the other functions give stock, supplier, listing and action tables.  Attributes
the star schema lacks (lead times, stock levels) are integer arithmetic on keys,
so that they are the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.sources.sales import normalise_columns


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unit_price() -> Column:
    """Price of one unit in whole cents."""
    return F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + F.lit(0.5)) / 100


def store_regions(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name")
    )


def sales_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Line items by region and brand under shop-style headers."""
    return (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(store_regions(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_shipdate").cast("date").alias("Date"),
            F.col("r_name").alias("Location"),
            F.col("p_type").alias("Product_Category"),
            F.col("p_brand").alias("Product_Name"),
            unit_price().alias("Unit_Price"),
            F.col("l_quantity").alias("Quantity"),
            F.col("l_discount").alias("Discount_Applied"),
        )
    )


def sales(spark: SparkSession, folder: str, *, category: bool = False) -> DataFrame:
    df = normalise_columns(sales_headers(spark, folder))
    return df if category else df.drop("category")


def sales_fine(spark: SparkSession, folder: str) -> DataFrame:
    """Line items by supplier and part: the number of series grows with the data."""
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_suppkey").cast("string").alias("store_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        unit_price().alias("price"),
        F.col("l_quantity").alias("sales"),
        F.col("l_discount").alias("Discount_Applied"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """One inventory item per traded supplier and part, demand = units ever sold."""
    key = F.col("l_suppkey") * 7 + F.col("l_partkey")
    traded = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.sum("l_quantity").cast("bigint").alias("forecast_demand"))
    )
    return traded.select(
        F.col("l_suppkey").cast("string").alias("store_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        (key * 37 % 200).cast("bigint").alias("current_stock"),
        (key % 4 * 5).cast("bigint").alias("incoming_stock"),
        (key % 3 * 2).cast("bigint").alias("reserved_stock"),
        "forecast_demand",
        F.when(key % 17 == 0, 0).otherwise(7).cast("bigint").alias("forecast_horizon"),
        (1 + key % 5).cast("bigint").alias("lead_time_days"),
        (1 + key % 4 * 10).cast("bigint").alias("minimum_order_quantity"),
        (1 + key % 3 * 6).cast("bigint").alias("order_multiple"),
        F.when(key % 5 == 0, F.lit(3)).cast("bigint").alias("shelf_life_days"),
        F.when(key % 6 == 0, F.lit(90)).cast("bigint").alias("maximum_inventory"),
        (key % 11 != 0).alias("supplier_availability"),
    )


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders seen as surplus listings of the customer's region."""
    place = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name")
    )
    key = F.col("o_orderkey")
    return (
        table(spark, folder, "orders")
        .join(place, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.lit("lst_"), key.cast("string")).alias("id"),
            F.col("r_name").alias("seller_store_id"),
            F.concat(F.lit("Brand#"), (1 + key % 25).cast("string")).alias("product_id"),
            (1 + key % 60).cast("bigint").alias("available_qty"),
            F.col("o_totalprice").alias("price_per_unit"),
            F.when(key % 3 != 0, (key % 9).cast("int")).alias("expiry_days"),
            F.col("o_orderdate").cast("date").alias("created_on"),
            F.when(F.col("o_orderstatus") == "O", "LISTED")
            .when(F.col("o_orderstatus") == "P", "MATCHED")
            .otherwise("COMPLETED")
            .alias("status"),
        )
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Line items seen as requests for the listing of their order."""
    return (
        table(spark, folder, "lineitem")
        .join(store_regions(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat_ws("_", F.lit("tx"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("id"),
            F.concat(F.lit("lst_"), F.col("l_orderkey").cast("string")).alias("listing_id"),
            F.col("r_name").alias("buyer_store_id"),
            F.col("l_quantity").cast("bigint").alias("requested_qty"),
            F.col("l_shipdate").cast("date").alias("requested_on"),
        )
    )


# The reading of the event types as transfer actions.
ACTION_OF_EVENT = {"view": "REQUEST", "click": "ACCEPT", "signup": "CONFIRM", "purchase": "COMPLETE", "error": "REJECT"}


def as_actions(events: DataFrame) -> DataFrame:
    """Events seen as actions on the transfer of one user and day."""
    action = F.create_map(*[F.lit(x) for pair in ACTION_OF_EVENT.items() for x in pair])
    return events.select(
        F.concat_ws("_", F.col("user_id"), F.date_format("ts", "yyyyMMdd")).alias("transfer_id"),
        "event_id",
        "ts",
        F.element_at(action, F.col("event_type")).alias("action"),
        "user_id",
    )


def actions(spark: SparkSession, folder: str) -> DataFrame:
    return as_actions(table(spark, folder, "events"))


def registry_events(spark: SparkSession, folder: str, *, views: bool = True) -> DataFrame:
    """Events seen as model registrations and rollbacks; one series per user.  ``views`` may be left out."""
    events = table(spark, folder, "events")
    if not views:
        events = events.where(F.col("event_type") != "view")
    return events.select(
        F.concat(F.lit("store_"), (F.col("user_id") % 7).cast("string")).alias("store_id"),
        F.concat(F.lit("item_"), F.col("user_id").cast("string")).alias("product_id"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("version_id"),
        F.when(F.col("event_type").isin("error", "click"), "ROLLBACK").otherwise("REGISTER").alias("event"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
    )


def served_requests(spark: SparkSession, folder: str) -> DataFrame:
    """View events seen as requests for a series' forecast, with what was sold and what was forecast."""
    views = table(spark, folder, "events").where(F.col("event_type") == "view")
    return views.select(
        F.concat(F.lit("store_"), (F.col("user_id") % 7).cast("string")).alias("store_id"),
        F.concat(F.lit("item_"), F.col("user_id").cast("string")).alias("product_id"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("actual"),
        (F.col("value") * (1 + (F.col("event_id") % 9 - 3) / 23)).alias("forecast"),
    )
