"""Reorder decisions, recommendations, surplus exchange and access."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.catalog import Entry, plain, rounded
from shelfcast.catalog.data import panel
from shelfcast.catalog.forecasting import coming
from shelfcast.catalog.sql import decision_parts, part, query, r
from shelfcast.functions.keys import SERIES
from shelfcast.operators import access, exchange, inventory
from shelfcast.sources import retail
from shelfcast.sources.retail import table

ENTRIES: dict[str, Entry] = {}
AS_OF = date(1998, 6, 1)


def entry(name: str, sql: str | None = None):
    def add(run):
        ENTRIES[name] = Entry(lambda spark, folder: plain(run(spark, folder)), sql)
        return run

    return add


# --- decisions on traded items ----------------------------------------------------------------

_ITEMS = """
SELECT CAST(l_suppkey AS VARCHAR) AS store_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST(k * 37 % 200 AS BIGINT) AS current_stock,
       k % 4 * 5 AS incoming_stock, k % 3 * 2 AS reserved_stock, forecast_demand, CASE WHEN k % 17 = 0 THEN 0 ELSE 7 END AS forecast_horizon,
       1 + k % 5 AS lead_time_days, 1 + k % 4 * 10 AS minimum_order_quantity, 1 + k % 3 * 6 AS order_multiple,
       CASE WHEN k % 5 = 0 THEN 3 END AS shelf_life_days, CASE WHEN k % 6 = 0 THEN 90 END AS maximum_inventory, k % 11 <> 0 AS supplier_availability,
       CAST(NULL AS BIGINT) AS daily_ltd
FROM (SELECT l_suppkey, l_partkey, l_suppkey * 7 + l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS forecast_demand FROM lineitem GROUP BY ALL)
"""
decision_parts("i_", "", _ITEMS)
_DECISION_SQL = f"store_id, should_reorder, {', '.join(inventory.DECISION_COLUMNS)}"


@entry("i01_i17_decisions", query("i_decisions", f"SELECT {_DECISION_SQL} FROM i_decisions"))
def _(spark, folder):
    decided = inventory.decide(retail.items(spark, folder))
    return decided.select("store_id", "should_reorder", *inventory.DECISION_COLUMNS)


@entry(
    "i17_defaults",
    query(
        "i_decisions",
        """
, bare AS (SELECT store_id, product_id, current_stock, forecast_demand, forecast_horizon, CASE WHEN forecast_horizon > 0 THEN CAST(forecast_demand AS DOUBLE) / forecast_horizon ELSE 0 END AS a FROM i_base),
 l AS (SELECT *, CAST(trunc(a * 3) AS BIGINT) AS ltd FROM bare),
 s AS (SELECT *, CAST(ceil(CAST(2.33 AS DOUBLE) * CASE WHEN ltd > 0 THEN sqrt(ltd) ELSE 1 END) AS BIGINT) AS ss FROM l),
 t AS (SELECT *, CAST(ceil(a * 14 + ltd + ss) AS BIGINT) AS target FROM s)
SELECT store_id, product_id, ltd AS lead_time_demand, ss AS safety_stock, target AS target_stock,
       CASE WHEN current_stock <= ltd + ss THEN greatest(target - current_stock, 0) ELSE 0 END AS recommended_order FROM t
""",
    ),
)
def _(spark, folder):
    """Only stock and demand given; a higher service level and a two-week review."""
    bare = retail.items(spark, folder).select(*SERIES, "current_stock", "forecast_demand", "forecast_horizon")
    policy = inventory.InventoryPolicy(service_level=0.99, review_period_days=14)
    return inventory.decide(bare, policy=policy).select(
        *SERIES, "lead_time_demand", "safety_stock", "target_stock", "recommended_order"
    )


_SURPLUS = """
 CASE WHEN current_stock - forecast_demand > 0 THEN 'SURPLUS' ELSE stock_status END AS stock_status,
 CASE WHEN current_stock - forecast_demand > 0 THEN 0 ELSE recommended_order END AS recommended_order,
 CASE WHEN current_stock - forecast_demand > 0 THEN 'Stock safely exceeds future demand projections. We recommend transferring '
      || (current_stock - forecast_demand) || ' excess units to the Surplus Exchange network.' ELSE reason END AS reason"""


@entry("i18_surplus", query("i_decisions", f"SELECT store_id, product_id, {_SURPLUS} FROM i_decisions"))
def _(spark, folder):
    return inventory.surplus_override(inventory.decide(retail.items(spark, folder))).select(
        *SERIES, "stock_status", "recommended_order", "reason"
    )


_ALERT = """
SELECT store_id, product_id, stock_status, safety_stock, CASE WHEN target_stock <> 0 THEN target_stock - reorder_point ELSE 20 END AS reported_safety,
 '*Stock Alert*' || chr(10) || chr(10) || 'Product: ' || product_id || chr(10) || 'Current Stock: ' || current_stock || chr(10) || 'Forecast Demand: ' || forecast_demand
 || chr(10) || 'Safety Stock: ' || CASE WHEN target_stock <> 0 THEN target_stock - reorder_point ELSE 20 END || chr(10) || 'Recommended Reorder: ' || recommended_order
 || chr(10) || chr(10) || 'Restocking this product is recommended.' AS message
"""


@entry("i20_alerts", query("i_decisions", f"{_ALERT} FROM i_decisions WHERE stock_status IN ('REORDER', 'CRITICAL')"))
def _(spark, folder):
    return inventory.alerts(inventory.decide(retail.items(spark, folder)))


# --- decisions on forecasts ---------------------------------------------------------------------


def stock(rows: DataFrame) -> DataFrame:
    """Stock and supplier of every region and brand."""
    b = F.substring("product_id", 7, 9).cast("bigint")
    n = F.length("store_id").cast("bigint")
    key = b * 13 + n * 7
    return (
        rows.select(*SERIES)
        .distinct()
        .select(
            *SERIES,
            (key * 37 % 400).alias("current_stock"),
            (key % 4 * 5).alias("incoming_stock"),
            (key % 3 * 2).alias("reserved_stock"),
            (1 + key % 9).alias("lead_time_days"),
            (1 + key % 4 * 10).alias("minimum_order_quantity"),
            (1 + key % 3 * 6).alias("order_multiple"),
            F.when(key % 5 == 0, 3).cast("bigint").alias("shelf_life_days"),
            F.when(key % 6 == 0, 500).cast("bigint").alias("maximum_inventory"),
            (key % 11 != 0).alias("supplier_availability"),
        )
    )


_STOCK = """
SELECT store_id, product_id, CAST(k * 37 % 400 AS BIGINT) AS current_stock, k % 4 * 5 AS incoming_stock, k % 3 * 2 AS reserved_stock,
       1 + k % 9 AS lead_time_days, 1 + k % 4 * 10 AS minimum_order_quantity, 1 + k % 3 * 6 AS order_multiple,
       CASE WHEN k % 5 = 0 THEN 3 END AS shelf_life_days, CASE WHEN k % 6 = 0 THEN 500 END AS maximum_inventory, k % 11 <> 0 AS supplier_availability
FROM (SELECT DISTINCT store_id, product_id, CAST(substr(product_id, 7) AS BIGINT) * 13 + length(store_id) * 7 AS k FROM days)
"""
part("stocked", "days", _STOCK)
part("total_demand", "coming", "SELECT store_id, product_id, CAST(sum(predicted_demand) AS BIGINT) AS demand, count(*) AS days FROM coming GROUP BY ALL")
part(
    "daily_ltd",
    "coming stocked",
    """
SELECT s.store_id, s.product_id, CASE WHEN max(place) >= max(s.lead_time_days) THEN CAST(sum(CASE WHEN place <= s.lead_time_days THEN predicted_demand ELSE 0 END) AS BIGINT) END AS ltd
FROM stocked s JOIN (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date) AS place FROM coming) c
  ON s.store_id = c.store_id AND s.product_id = c.product_id GROUP BY ALL
""",
)
decision_parts(
    "r_",
    "stocked total_demand daily_ltd",
    """
SELECT s.*, t.demand AS forecast_demand, t.days AS forecast_horizon, d.ltd AS daily_ltd
FROM stocked s JOIN total_demand t ON s.store_id = t.store_id AND s.product_id = t.product_id
JOIN daily_ltd d ON s.store_id = d.store_id AND s.product_id = d.product_id
""",
)


@entry(
    "i02_lead_time_demand",
    query("r_decisions", "SELECT store_id, product_id, lead_time_days, lead_time_demand, safety_stock, reorder_point FROM r_decisions"),
)
def _(spark, folder):
    _, days = coming(spark, folder)
    decided = inventory.recommend(stock(days), days)
    return decided.select(*SERIES, "lead_time_days", "lead_time_demand", "safety_stock", "reorder_point")


@entry(
    "i21_recommendations",
    query("r_decisions", f"SELECT * REPLACE ({_SURPLUS}) FROM (SELECT {_DECISION_SQL} FROM r_decisions)"),
)
def _(spark, folder):
    _, days = coming(spark, folder)
    return inventory.recommend(stock(days), days).select("store_id", "should_reorder", *inventory.DECISION_COLUMNS)


@entry(
    "i19_simple_recommendation",
    query(
        "stocked total_demand",
        """
SELECT s.store_id, s.product_id, coalesce(demand, 0) AS total_forecast_demand, greatest(coalesce(demand, 0) + 20 - current_stock, 0) AS recommended_reorder,
       CASE WHEN current_stock <= 20 THEN 'CRITICAL' WHEN current_stock < 20 + coalesce(demand, 0) * 0.3::DOUBLE THEN 'REORDER NOW'
            WHEN current_stock < 20 + coalesce(demand, 0) * 0.6::DOUBLE THEN 'LOW STOCK' ELSE 'SAFE' END AS status
FROM stocked s LEFT JOIN total_demand t ON s.store_id = t.store_id AND s.product_id = t.product_id
""",
    ),
)
def _(spark, folder):
    _, days = coming(spark, folder)
    held = stock(days).withColumn("safety_stock", F.lit(20).cast("bigint"))
    return inventory.simple_recommendation(held, days)


@entry(
    "r01_reorder_plan",
    query(
        "r_decisions days",
        f"""
SELECT store_id, product_id, (SELECT max(date) FROM days) AS last_date, forecast_demand AS demand_7d, lead_time_demand, safety_stock, reorder_point,
       target_stock, stockout_risk, {_SURPLUS} FROM r_decisions
""",
    ),
)
def _(spark, folder):
    """Seven-day demand, reorder quantity and stock status of every region and brand."""
    _, days = coming(spark, folder)
    last = days.groupBy(*SERIES).agg(F.date_sub(F.min("date"), 1).alias("last_date"))
    plan = inventory.recommend(stock(days), days).join(last, SERIES)
    return plan.select(
        *SERIES,
        "last_date",
        F.col("forecast_demand").alias("demand_7d"),
        "lead_time_demand",
        "safety_stock",
        "reorder_point",
        "target_stock",
        "recommended_order",
        "stock_status",
        "stockout_risk",
        "reason",
    )


@entry(
    "i22_stock_figures",
    query(
        "dense",
        f"""
, g AS (SELECT store_id, product_id, sales AS demand, CAST((CAST(date - DATE '1995-01-01' AS INTEGER) * 37 + length(store_id) * 11) % 90 AS DOUBLE) AS opening FROM dense)
SELECT store_id, product_id, round_even(count_if(least(demand, opening) < demand) / count(*) * 100, 1) AS stockout_rate,
       round_even(CASE WHEN sum(demand) > 0 THEN sum(least(demand, opening)) / sum(demand) ELSE 1 END * 100, 1) AS fill_rate,
       {r('avg(opening - least(demand, opening))')} AS average_inventory,
       round_even(count_if(opening - least(demand, opening) > 3 * greatest(demand, 1)) / count(*) * 100, 1) AS overstock_rate
FROM g GROUP BY store_id, product_id
""",
    ),
)
def _(spark, folder):
    """A daily log from the panel: demand is sales, the opening stock follows from the day."""
    day = F.datediff("date", F.lit(date(1995, 1, 1)))
    opening = ((day * 37 + F.length("store_id") * 11) % 90).cast("double")
    log = panel(spark, folder).select(
        *SERIES,
        F.col("sales").alias("demand"),
        F.least("sales", opening).alias("fulfilled"),
        (opening - F.least("sales", opening)).alias("end_stock"),
    )
    return rounded(inventory.stock_figures(log))


# --- surplus exchange ---------------------------------------------------------------------------

part(
    "offers",
    "",
    """
SELECT 'lst_' || o_orderkey AS id, r_name AS seller_store_id, 'Brand#' || (1 + o_orderkey % 25) AS product_id, 1 + o_orderkey % 60 AS available_qty, 1 AS min_qty,
       o_totalprice AS price_per_unit,
       CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 9 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS DATE) END AS expiry_date,
       CAST(o_orderdate AS DATE) AS created_on, CASE o_orderstatus WHEN 'O' THEN 'LISTED' WHEN 'P' THEN 'MATCHED' ELSE 'COMPLETED' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
)
part(
    "asked",
    "",
    """
SELECT 'tx_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id, 'lst_' || l_orderkey AS listing_id, r_name AS buyer_store_id,
       CAST(l_quantity AS BIGINT) AS requested_qty, CAST(l_shipdate AS DATE) AS requested_on
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
)


def _distance_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0 ELSE round_even(abs(length({a}) - length({b})) * CAST(1.5 AS DOUBLE) + CAST(1.2 AS DOUBLE), 1) END"


def offers(spark, folder) -> DataFrame:
    return exchange.create_listings(retail.listings(spark, folder))


@entry("x01_listings", query("offers", "SELECT * FROM offers"))
def _(spark, folder):
    return offers(spark, folder)


@entry(
    "x02_x04_active_listings",
    query(
        "offers",
        f"""
SELECT *, {_distance_sql("'ASIA'", 'seller_store_id')} AS distance_km
FROM offers WHERE status = 'LISTED' AND seller_store_id <> 'ASIA'
""",
    ),
)
def _(spark, folder):
    return exchange.active_listings(offers(spark, folder), "ASIA")


@entry(
    "x03_store_requests",
    query(
        "offers asked",
        "SELECT * FROM asked WHERE listing_id IN (SELECT id FROM offers WHERE seller_store_id = 'EUROPE')",
    ),
)
def _(spark, folder):
    return exchange.requests_for(offers(spark, folder), retail.requests(spark, folder), "EUROPE")


part(
    "buyers",
    "coming",
    """
SELECT store_id, product_id, CAST(sum(predicted_demand) AS BIGINT) AS forecast_demand, count(*) AS forecast_horizon, 5 AS current_stock, 0 AS incoming_stock,
       0 AS reserved_stock, 2 AS lead_time_days, 1 AS minimum_order_quantity, 1 AS order_multiple, CAST(NULL AS BIGINT) AS shelf_life_days,
       CAST(NULL AS BIGINT) AS maximum_inventory, true AS supplier_availability,
       CAST(sum(CASE WHEN place <= 2 THEN predicted_demand ELSE 0 END) AS BIGINT) AS daily_ltd
FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date) AS place FROM coming) GROUP BY store_id, product_id
""",
)
decision_parts("b_", "buyers", "SELECT * FROM buyers")


@entry(
    "x05_x06_matches",
    query(
        "offers b_decisions",
        f"""
, pairs AS (
SELECT o.id AS listing_id, o.product_id, o.seller_store_id, b.store_id AS buyer_store_id, {_distance_sql('o.seller_store_id', 'b.store_id')} AS distance_km,
       b.target_stock - 5 AS predicted_shortage, b.stockout_risk, least(b.target_stock - 5, o.available_qty) AS recommended_transfer,
       CASE WHEN date_diff('day', DATE '1998-06-01', o.expiry_date) <= 3 THEN 40 ELSE 0 END AS urgent
FROM offers o JOIN b_decisions b ON o.product_id = b.product_id AND o.seller_store_id <> b.store_id
WHERE b.stock_status IN ('REORDER', 'CRITICAL', 'LOW_STOCK') AND b.target_stock - 5 > 0),
scored AS (SELECT * EXCLUDE (urgent), round_even(CASE stockout_risk WHEN 'CRITICAL' THEN 50 WHEN 'HIGH' THEN 30 ELSE 0 END - distance_km * 2 + urgent, 1) AS match_score FROM pairs)
SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY match_score DESC, buyer_store_id) AS match_rank FROM scored
""",
    ),
)
def _(spark, folder):
    _, days = coming(spark, folder)
    return exchange.match(offers(spark, folder), days, as_of=AS_OF)


part(
    "judged_requests",
    "offers asked",
    """
SELECT a.*, CASE WHEN status IS DISTINCT FROM 'LISTED' OR coalesce((requested_on, a.id) > (first_on, first_id), false) THEN 'Listing unavailable'
                 WHEN requested_qty > available_qty THEN 'Requested quantity exceeds available' ELSE 'accepted' END AS outcome
FROM asked a LEFT JOIN (SELECT id AS oid, status, available_qty FROM offers) ON listing_id = oid
LEFT JOIN (SELECT listing_id AS fid, requested_on AS first_on, x.id AS first_id,
                  row_number() OVER (PARTITION BY listing_id ORDER BY requested_on, x.id) AS place
           FROM asked x JOIN offers o ON x.listing_id = o.id WHERE o.status = 'LISTED' AND requested_qty <= available_qty) ON fid = listing_id AND place = 1
""",
)


@entry("x07_requests", query("judged_requests", "SELECT * FROM judged_requests"))
def _(spark, folder):
    return exchange.apply_requests(offers(spark, folder), retail.requests(spark, folder))


@entry(
    "x07_listings_after_requests",
    query(
        "offers judged_requests",
        """
SELECT id, CASE WHEN id IN (SELECT listing_id FROM judged_requests WHERE outcome = 'accepted') THEN 'MATCHED' ELSE status END AS status FROM offers
""",
    ),
)
def _(spark, folder):
    listings = offers(spark, folder)
    judged = exchange.apply_requests(listings, retail.requests(spark, folder))
    return exchange.matched_listings(listings, judged).select("id", "status")


part(
    "acts",
    "",
    """
SELECT user_id || '_' || strftime(ts, '%Y%m%d') AS transfer_id, event_id, ts, user_id,
       CASE event_type WHEN 'view' THEN 'REQUEST' WHEN 'click' THEN 'ACCEPT' WHEN 'signup' THEN 'CONFIRM' WHEN 'purchase' THEN 'COMPLETE' ELSE 'REJECT' END AS action
FROM events
""",
)
part("acc", "acts", "SELECT transfer_id, min((ts, event_id)) AS t0 FROM acts WHERE action = 'ACCEPT' GROUP BY transfer_id")
part(
    "conf",
    "acts acc",
    "SELECT a.transfer_id, min((ts, event_id)) AS t1 FROM acts a JOIN acc USING (transfer_id) WHERE action = 'CONFIRM' AND (ts, event_id) > t0 GROUP BY a.transfer_id",
)
part(
    "comp",
    "acts conf",
    "SELECT a.transfer_id, min((ts, event_id)) AS t2, min(ts) AS done_at FROM acts a JOIN conf USING (transfer_id) WHERE action = 'COMPLETE' AND (ts, event_id) > t1 GROUP BY a.transfer_id",
)
part(
    "transfers",
    "acts acc conf comp",
    """
SELECT transfer_id, CASE WHEN t2 IS NOT NULL THEN 'COMPLETED' WHEN t1 IS NOT NULL THEN 'IN_TRANSIT' WHEN t0 IS NOT NULL THEN 'ACCEPTED' ELSE 'REQUESTED' END AS state,
       actions, CAST(steps - (t0 IS NOT NULL)::INT - (t1 IS NOT NULL)::INT - (t2 IS NOT NULL)::INT AS BIGINT) AS refused, CAST(done_at AS DATE) AS completed_on, user_id
FROM (SELECT transfer_id, count(*) AS actions, count_if(action IN ('ACCEPT', 'CONFIRM', 'COMPLETE')) AS steps, min(user_id) AS user_id FROM acts GROUP BY transfer_id)
LEFT JOIN acc USING (transfer_id) LEFT JOIN conf USING (transfer_id) LEFT JOIN comp USING (transfer_id)
""",
)


@entry("x08_transfers", query("transfers", "SELECT * EXCLUDE (user_id, completed_on), coalesce(strftime(completed_on, '%Y-%m-%d'), '') AS completed_on FROM transfers"))
def _(spark, folder):
    folded = exchange.fold_transfers(retail.actions(spark, folder))
    return folded.withColumn("completed_on", F.coalesce(F.date_format("completed_at", "yyyy-MM-dd"), F.lit(""))).drop("completed_at")


@entry(
    "x09_stock_changes",
    query(
        "transfers",
        """
, l AS (SELECT 'item_' || user_id % 11 AS product_id, 'store_' || user_id % 7 AS seller, 'store_' || (user_id + 3) % 7 AS buyer, actions AS qty FROM transfers WHERE state = 'COMPLETED')
SELECT store_id, product_id, CAST(sum(change) AS BIGINT) AS change
FROM (SELECT seller AS store_id, product_id, -qty AS change FROM l UNION ALL SELECT buyer, product_id, qty FROM l) GROUP BY store_id, product_id
""",
    ),
)
def _(spark, folder):
    """Stock moved by completed transfers; parties and goods follow from the user."""
    user = F.split("transfer_id", "_")[0].cast("bigint")
    transfers = exchange.fold_transfers(retail.actions(spark, folder)).select(
        "transfer_id",
        "state",
        F.concat(F.lit("store_"), (user % 7).cast("string")).alias("seller_store_id"),
        F.concat(F.lit("store_"), ((user + 3) % 7).cast("string")).alias("buyer_store_id"),
        F.concat(F.lit("item_"), (user % 11).cast("string")).alias("product_id"),
        F.col("actions").alias("qty"),
    )
    return exchange.stock_changes(exchange.movements(transfers))


# --- access ---------------------------------------------------------------------------------------


def users(spark, folder) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.col("c_name").alias("user"),
        F.when(key % 50 == 0, "ADMIN").otherwise("STAFF").alias("role"),
        F.when(key % 10 == 3, "*").when(key % 10 == 7, "ASIA, EUROPE").when(key % 10 == 9, None).otherwise("AFRICA").alias("authorized_stores"),
    )


def _seen(spark, folder, user: str) -> DataFrame:
    rows = access.restrict(retail.sales(spark, folder), users(spark, folder), user)
    return rows.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("sales"))


@entry(
    "x10_staff_rows",
    query("raw", "SELECT store_id, count(*) AS n, sum(sales) AS sales FROM raw WHERE store_id IN ('ASIA', 'EUROPE') GROUP BY store_id"),
)
def _(spark, folder):
    return _seen(spark, folder, "Customer#000000017")


@entry("x10_admin_rows", query("raw", "SELECT store_id, count(*) AS n, sum(sales) AS sales FROM raw GROUP BY store_id"))
def _(spark, folder):
    return _seen(spark, folder, "Customer#000000050")
