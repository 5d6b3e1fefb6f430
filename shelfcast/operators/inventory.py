"""Reorder decisions as column expressions, one row per item."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES
from shelfcast.functions.numeric import half_even, ratio


@dataclass(frozen=True)
class InventoryPolicy:
    """Defaults of the decision rules."""

    service_level: float = 0.95
    review_period_days: int = 7
    default_lead_time_days: int = 3
    use_minimum_order: bool = True
    use_order_multiple: bool = True
    use_shelf_life: bool = True
    use_maximum: bool = True
    maximum_inventory: int | None = None


# Service levels and factors, shares of the status and risk bands.
SERVICE_FACTORS = [(0.99, 2.33), (0.95, 1.645)]
LOWEST_SERVICE_FACTOR = 1.28
LOW_STOCK_SHARE = 0.3
STOCKOUT_SHARES = [(0.2, "CRITICAL"), (0.5, "HIGH"), (1.0, "MEDIUM")]
OVERSTOCK_TIMES = [(3, "HIGH"), (2, "MEDIUM")]
ADEQUATE = "Stock levels are adequate."
DECISION_VERSION = "1.0"
ALERT_STATUSES = ["REORDER", "CRITICAL"]

ITEM_DEFAULTS = {
    "reserved_stock": 0,
    "incoming_stock": 0,
    "minimum_order_quantity": 1,
    "order_multiple": 1,
    "supplier_availability": True,
}
OPTIONAL_LIMITS = ["shelf_life_days", "maximum_inventory"]

DECISION_COLUMNS = [
    "product_id",
    "current_stock",
    "reserved_stock",
    "incoming_stock",
    "inventory_position",
    "forecast_demand",
    "lead_time_days",
    "lead_time_demand",
    "safety_stock",
    "reorder_point",
    "target_stock",
    "recommended_order",
    "stock_status",
    "stockout_risk",
    "overstock_risk",
    "reason",
    "decision_version",
]


def service_factor(service_level: float) -> float:
    return next((z for level, z in SERVICE_FACTORS if service_level >= level), LOWEST_SERVICE_FACTOR)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def with_defaults(items: DataFrame, policy: InventoryPolicy = InventoryPolicy()) -> DataFrame:
    """Absent or null inputs take their defaults."""
    for column, value in ITEM_DEFAULTS.items():
        items = items.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in items.columns else F.lit(value))
    lead = F.lit(policy.default_lead_time_days)
    items = items.withColumn(
        "lead_time_days", F.coalesce(F.col("lead_time_days"), lead) if "lead_time_days" in items.columns else lead
    )
    for column in OPTIONAL_LIMITS:
        if column not in items.columns:
            items = items.withColumn(column, F.lit(None).cast("bigint"))
    if policy.maximum_inventory is not None:
        items = items.withColumn("maximum_inventory", F.coalesce("maximum_inventory", F.lit(policy.maximum_inventory)))
    return items


def daily_units(daily_forecasts: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Each item's coming days in order, as one array no longer than the horizon, and their total."""
    day = F.struct("date", F.col("predicted_demand").cast("bigint").alias("units"))
    return daily_forecasts.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(day)), lambda d: d["units"]).alias("daily_units"),
        F.sum("predicted_demand").cast("bigint").alias("forecast_demand"),
        F.count(F.lit(1)).alias("forecast_horizon"),
    )


def lead_time_demand(items: DataFrame) -> DataFrame:
    """The first lead-time days of ``daily_units``, else the average day times the lead time."""
    demand, horizon = F.col("forecast_demand").cast("double"), F.col("forecast_horizon").cast("double")
    items = items.withColumn("_avg_daily", F.when(horizon > 0, ratio(demand, horizon)).otherwise(0.0))
    average = (F.col("_avg_daily") * F.col("lead_time_days")).cast("bigint")
    if "daily_units" not in items.columns:
        return items.withColumn("lead_time_demand", average)
    enough = F.col("daily_units").isNotNull() & (F.size("daily_units") >= F.col("lead_time_days"))
    first_days = F.slice("daily_units", F.lit(1), F.greatest(F.col("lead_time_days").cast("int"), F.lit(0)))
    summed = F.aggregate(first_days, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return items.withColumn("lead_time_demand", F.when(enough, summed).otherwise(average)).drop("daily_units")


def _limit(column: str) -> Column:
    """An optional limit counts when it is neither null nor zero."""
    return F.coalesce(F.col(column) != 0, F.lit(False))


def decide(
    items: DataFrame,
    daily_forecasts: DataFrame | None = None,
    policy: InventoryPolicy = InventoryPolicy(),
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """The decision for every item.

    Needs ``current_stock, forecast_demand, forecast_horizon``; other inputs have
    defaults.  With ``daily_units`` on the items, or daily forecasts to join, the
    lead time demand is exact.  Apart from that join this is one projection.
    """
    if daily_forecasts is not None:
        items = items.join(daily_units(daily_forecasts, by).select(*by, "daily_units"), list(by), "left")
    kept = [c for c in items.columns if c not in (*DECISION_COLUMNS, "daily_units")]
    rows = lead_time_demand(with_defaults(items, policy))
    position = F.col("inventory_position")
    z = F.lit(service_factor(policy.service_level))
    root = F.when(F.col("lead_time_demand") > 0, F.sqrt("lead_time_demand")).otherwise(1.0)
    rows = rows.withColumn("inventory_position", F.col("current_stock") + F.col("incoming_stock") - F.col("reserved_stock"))
    rows = rows.withColumn("safety_stock", F.ceil(z * root))
    rows = rows.withColumn("reorder_point", F.col("lead_time_demand") + F.col("safety_stock"))
    review = F.col("_avg_daily") * F.lit(policy.review_period_days)
    rows = rows.withColumns(
        {
            "should_reorder": position <= F.col("reorder_point"),
            "target_stock": F.ceil(review + F.col("lead_time_demand") + F.col("safety_stock")),
        }
    )

    # Order quantity: base, then maximum, minimum, multiple and shelf life, in this order.
    orders = F.col("should_reorder") & F.col("supplier_availability")
    rows = rows.withColumn("_q0", F.greatest(F.col("target_stock") - position, F.lit(0)))
    has_max = _limit("maximum_inventory") if policy.use_maximum else F.lit(False)
    room = F.greatest(F.col("maximum_inventory") - position, F.lit(0))
    rows = rows.withColumn("_capped", has_max & (F.col("_q0") > room))
    rows = rows.withColumn("_q1", F.when(F.col("_capped"), room).otherwise(F.col("_q0")))

    minimum = F.col("minimum_order_quantity")
    raised = (minimum > 1) & (F.col("_q1") > 0) & (F.col("_q1") < minimum) if policy.use_minimum_order else F.lit(False)
    rows = rows.withColumn("_raised", raised)
    rows = rows.withColumn("_q2", F.when(F.col("_raised"), minimum).otherwise(F.col("_q1")))

    multiple = F.col("order_multiple")
    over = F.when(multiple > 1, F.pmod(F.col("_q2"), F.when(multiple > 1, multiple).otherwise(1))).otherwise(0)
    rows = rows.withColumn("_over", over if policy.use_order_multiple else F.lit(0))
    rows = rows.withColumn("_rounded", (F.col("_q2") > 0) & (F.col("_over") != 0))
    rows = rows.withColumn("_q3", F.when(F.col("_rounded"), F.col("_q2") + multiple - F.col("_over")).otherwise(F.col("_q2")))

    sellable = (F.col("_avg_daily") * F.col("shelf_life_days")).cast("bigint")
    perishable = _limit("shelf_life_days") if policy.use_shelf_life else F.lit(False)
    rows = rows.withColumn("_sellable", sellable)
    rows = rows.withColumn("_expires", perishable & (F.col("_q3") > F.col("_sellable")))
    rows = rows.withColumn("_q4", F.when(F.col("_expires"), F.col("_sellable")).otherwise(F.col("_q3")))
    rows = rows.withColumn("recommended_order", F.when(orders, F.col("_q4")).otherwise(0).cast("bigint"))

    reasons = F.array(
        F.when(~F.col("should_reorder"), "Inventory position is above reorder point.").when(
            ~F.col("supplier_availability"), "Supplier is unavailable."
        ),
        F.when(orders & F.col("_capped"), _text("Order capped by max inventory limit (", F.col("maximum_inventory"), ").")),
        F.when(orders & F.col("_raised"), _text("Order increased to meet minimum order quantity (", minimum, ").")),
        F.when(orders & F.col("_rounded"), _text("Order rounded up to match supplier multiple (", multiple, ").")),
        F.when(
            orders & F.col("_expires") & (F.col("_sellable") == 0),
            "Order set to zero because shelf life will expire before demand materializes.",
        ).when(
            orders & F.col("_expires"),
            _text("Order strictly capped by perishable shelf-life limit (", F.col("_sellable"), " units)."),
        ),
        F.when(
            orders & (F.col("_q4") > 0),
            _text("Inventory position (", position, ") dropped below reorder point (", F.col("reorder_point"), ")."),
        ),
    )
    text = F.concat_ws(" | ", F.array_compact(reasons))
    rows = rows.withColumns(
        {
            "reason": F.when(text == "", ADEQUATE).otherwise(text),
            "stock_status": stock_status(has_max),
            "stockout_risk": stockout_risk(position, F.col("forecast_demand")),
            "overstock_risk": overstock_risk(position, F.col("forecast_demand")),
            "decision_version": F.lit(DECISION_VERSION),
        }
    )
    return rows.select(*kept, "should_reorder", *DECISION_COLUMNS)


def stock_status(has_max: Column) -> Column:
    """I14"""
    position, point = F.col("inventory_position"), F.col("reorder_point")
    low = point + (F.col("target_stock") - point) * F.lit(LOW_STOCK_SHARE)
    return (
        F.when(has_max & (position > F.col("maximum_inventory")), "OVERSTOCK")
        .when(position <= F.col("safety_stock"), "CRITICAL")
        .when(position <= point, "REORDER")
        .when(position <= low, "LOW_STOCK")
        .otherwise("HEALTHY")
    )


def stockout_risk(position: Column, demand: Column) -> Column:
    """I15"""
    risk = None
    for share, name in STOCKOUT_SHARES:
        condition = position <= demand * F.lit(share)
        risk = F.when(condition, name) if risk is None else risk.when(condition, name)
    return risk.otherwise("LOW")


def overstock_risk(position: Column, demand: Column) -> Column:
    """I16"""
    risk = None
    for times, name in OVERSTOCK_TIMES:
        condition = position >= demand * times
        risk = F.when(condition, name) if risk is None else risk.when(condition, name)
    return risk.otherwise("LOW")


def surplus_override(decisions: DataFrame) -> DataFrame:
    """Stock above the whole forecast becomes SURPLUS, replacing any other status."""
    surplus = F.col("current_stock") - F.col("forecast_demand")
    offer = _text(
        "Stock safely exceeds future demand projections. We recommend transferring ",
        surplus,
        " excess units to the Surplus Exchange network.",
    )
    more = surplus > 0
    return decisions.withColumns(
        {
            "stock_status": F.when(more, "SURPLUS").otherwise(F.col("stock_status")),
            "recommended_order": F.when(more, F.lit(0).cast("bigint")).otherwise(F.col("recommended_order")),
            "reason": F.when(more, offer).otherwise(F.col("reason")),
        }
    )


def simple_recommendation(stock: DataFrame, daily_forecasts: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """I19 on ``(by, current_stock, safety_stock)``."""
    totals = daily_forecasts.groupBy(*by).agg(F.sum("predicted_demand").cast("bigint").alias("total_forecast_demand"))
    rows = stock.join(totals, list(by), "left").withColumn(
        "total_forecast_demand", F.coalesce("total_forecast_demand", F.lit(0).cast("bigint"))
    )
    stock_now, safety, demand = F.col("current_stock"), F.col("safety_stock"), F.col("total_forecast_demand")
    return rows.select(
        *by,
        "total_forecast_demand",
        F.greatest(demand + safety - stock_now, F.lit(0)).cast("bigint").alias("recommended_reorder"),
        F.when(stock_now <= safety, "CRITICAL")
        .when(stock_now < safety + demand * F.lit(0.3), "REORDER NOW")
        .when(stock_now < safety + demand * F.lit(0.6), "LOW STOCK")
        .otherwise("SAFE")
        .alias("status"),
    )


def alerts(decisions: DataFrame, *, title: str = "Stock Alert") -> DataFrame:
    """A message per item that must be ordered.

    ``reported_safety`` is the figure the message has always carried (target minus
    reorder point); ``safety_stock`` is the true one.
    """
    reported = F.when(F.col("target_stock") != 0, F.col("target_stock") - F.col("reorder_point")).otherwise(20)
    text = _text(
        f"*{title}*\n\nProduct: ",
        F.col("product_id"),
        "\nCurrent Stock: ",
        F.col("current_stock"),
        "\nForecast Demand: ",
        F.col("forecast_demand"),
        "\nSafety Stock: ",
        F.col("reported_safety"),
        "\nRecommended Reorder: ",
        F.col("recommended_order"),
        "\n\nRestocking this product is recommended.",
    )
    store = ["store_id"] if "store_id" in decisions.columns else []
    return (
        decisions.where(F.col("stock_status").isin(*ALERT_STATUSES))
        .withColumn("reported_safety", reported.cast("bigint"))
        .select(*store, "product_id", "stock_status", "safety_stock", "reported_safety", text.alias("message"))
    )


def recommend(stock: DataFrame, daily_forecasts: DataFrame, policy: InventoryPolicy = InventoryPolicy()) -> DataFrame:
    """Daily forecasts summed to demand, decided, and checked for surplus.

    Items without a forecast give no row.
    """
    return surplus_override(decide(stock.join(daily_units(daily_forecasts), SERIES), policy=policy))


def stock_figures(log: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """I22 on a daily log ``(by, demand, fulfilled, end_stock)``: rates in percent and mean stock."""
    days = F.count(F.lit(1))
    out_of_stock = F.count_if(F.col("fulfilled") < F.col("demand"))
    too_much = F.count_if(F.col("end_stock") > 3 * F.greatest(F.col("demand"), F.lit(1)))
    wanted = F.sum("demand")
    return log.groupBy(*by).agg(
        half_even(out_of_stock / days * 100, 1).alias("stockout_rate"),
        half_even(F.when(wanted > 0, F.sum("fulfilled") / wanted).otherwise(1.0) * 100, 1).alias("fill_rate"),
        F.avg("end_stock").alias("average_inventory"),
        half_even(too_much / days * 100, 1).alias("overstock_rate"),
    )
