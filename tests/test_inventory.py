from datetime import date, timedelta

import pytest

from shelfcast.operators import inventory

SCHEMA = """store_id string, product_id string, current_stock bigint, incoming_stock bigint, reserved_stock bigint, lead_time_days bigint,
minimum_order_quantity bigint, order_multiple bigint, shelf_life_days bigint, maximum_inventory bigint, forecast_demand bigint, forecast_horizon bigint,
supplier_availability boolean"""


def decide(spark, current, incoming, reserved, lead, moq, multiple, shelf, maximum, demand, horizon, available=True, days=None):
    items = spark.createDataFrame(
        [("S", "P", current, incoming, reserved, lead, moq, multiple, shelf, maximum, demand, horizon, available)], SCHEMA
    )
    daily = None
    if days is not None:
        daily = spark.createDataFrame(
            [("S", "P", date(2026, 1, 1) + timedelta(days=i), d) for i, d in enumerate(days)],
            "store_id string, product_id string, date date, predicted_demand bigint",
        )
    return inventory.decide(items, daily).first()


def test_position_and_lead_time_demand(spark):
    r = decide(spark, 100, 20, 0, 2, 1, 1, None, None, 70, 7)
    assert (r.inventory_position, r.lead_time_demand, r.stock_status, r.recommended_order) == (120, 20, "HEALTHY", 0)
    assert r.reason == "Inventory position is above reorder point."


def test_reorder(spark):
    r = decide(spark, 10, 0, 0, 3, 1, 1, None, None, 70, 7)
    assert r.inventory_position < r.reorder_point and r.recommended_order > 0


def test_maximum_inventory(spark):
    r = decide(spark, 10, 0, 0, 2, 1, 1, None, 50, 210, 7)
    assert r.recommended_order == 40 and "capped by max inventory" in r.reason


def test_minimum_order(spark):
    r = decide(spark, 5, 0, 0, 2, 100, 1, None, None, 35, 7)
    assert r.recommended_order == 100 and "minimum order quantity" in r.reason


def test_multiple(spark):
    assert decide(spark, 5, 0, 0, 2, 10, 12, None, None, 35, 7).recommended_order % 12 == 0


def test_shelf_life(spark):
    r = decide(spark, 2, 0, 0, 1, 1000, 1, 3, None, 70, 7)
    assert r.recommended_order == 30 and "capped by perishable shelf-life" in r.reason


def test_risk(spark):
    r = decide(spark, 5, 0, 0, 5, 1, 1, None, None, 100, 7)
    assert (r.stockout_risk, r.stock_status) == ("CRITICAL", "CRITICAL")


def test_no_demand(spark):
    r = decide(spark, 20, 0, 0, 5, 1, 1, None, None, 0, 7)
    assert (r.recommended_order, r.stockout_risk) == (0, "LOW")


def test_unavailable_supplier(spark):
    r = decide(spark, 1, 0, 0, 3, 1, 1, None, None, 70, 7, available=False)
    assert (r.recommended_order, r.reason) == (0, "Supplier is unavailable.")


@pytest.mark.parametrize("lead, want", [(2, 30), (3, 60), (4, 80), (0, 0)])
def test_daily_forecasts_are_used_when_they_reach(spark, lead, want):
    assert decide(spark, 5, 0, 0, lead, 1, 1, None, None, 60, 3, days=[10, 20, 30]).lead_time_demand == want


def test_zero_horizon(spark):
    r = decide(spark, 5, 0, 0, 4, 1, 1, None, None, 60, 0)
    assert (r.lead_time_demand, r.safety_stock, r.target_stock) == (0, 2, 2)


def test_defaults_and_surplus_and_alerts(spark):
    items = spark.createDataFrame([("S", "A", 500, 70, 7), ("S", "B", 3, 70, 7)], "store_id string, product_id string, current_stock bigint, forecast_demand bigint, forecast_horizon bigint")
    decided = inventory.surplus_override(inventory.decide(items))
    rows = {r.product_id: r for r in decided.collect()}
    assert rows["A"].stock_status == "SURPLUS" and rows["A"].recommended_order == 0 and "430 excess units" in rows["A"].reason
    assert rows["B"].lead_time_days == 3
    (alert,) = inventory.alerts(decided).collect()
    assert alert.product_id == "B" and "Current Stock: 3" in alert.message


def test_simple_recommendation(spark):
    stock = spark.createDataFrame([("S", p, c, 20) for p, c in (("A", 20), ("B", 25), ("C", 80), ("D", 90))], "store_id string, product_id string, current_stock bigint, safety_stock bigint")
    days = spark.createDataFrame([("S", p, date(2026, 1, 1), 100) for p in "ABCD"], "store_id string, product_id string, date date, predicted_demand bigint")
    got = {r.product_id: (r.recommended_reorder, r.status) for r in inventory.simple_recommendation(stock, days).collect()}
    assert got == {"A": (100, "CRITICAL"), "B": (95, "REORDER NOW"), "C": (40, "SAFE"), "D": (30, "SAFE")}
