"""Surplus listings, buyer matching and transfers between stores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.keys import SERIES
from shelfcast.functions.numeric import half_even
from shelfcast.functions.skew import hot_keys, skew_join
from shelfcast.operators.inventory import InventoryPolicy, daily_units, decide
from shelfcast.session import materialise

# Assumed stock and lead time of a buyer, score parts, state steps.
BUYER_STOCK = 5
BUYER_LEAD_TIME = 2
NEEDY = ["REORDER", "CRITICAL", "LOW_STOCK"]
RISK_SCORE = {"CRITICAL": 50, "HIGH": 30}
DISTANCE_WEIGHT = 2
URGENT_DAYS = 3
URGENT_SCORE = 40
LISTED, MATCHED, COMPLETED = "LISTED", "MATCHED", "COMPLETED"
FIRST_STATE = "REQUESTED"
TRANSITIONS = {
    ("REQUESTED", "ACCEPT"): "ACCEPTED",
    ("ACCEPTED", "CONFIRM"): "IN_TRANSIT",
    ("IN_TRANSIT", "COMPLETE"): "COMPLETED",
}
STEPS = [("ACCEPT", "ACCEPTED"), ("CONFIRM", "IN_TRANSIT"), ("COMPLETE", "COMPLETED")]


def create_listings(offers: DataFrame) -> DataFrame:
    """Offers ``(id, seller_store_id, product_id, available_qty, …, expiry_days, created_on)`` as listings."""
    days = F.when(F.col("expiry_days") != 0, F.col("expiry_days"))
    least = F.coalesce(F.col("min_qty"), F.lit(1)) if "min_qty" in offers.columns else F.lit(1)
    status = F.coalesce(F.col("status"), F.lit(LISTED)) if "status" in offers.columns else F.lit(LISTED)
    return offers.select(
        "id",
        "seller_store_id",
        "product_id",
        "available_qty",
        least.alias("min_qty"),
        "price_per_unit",
        F.date_add("created_on", days).alias("expiry_date"),
        "created_on",
        status.alias("status"),
    )


def distance(a: Column, b: Column) -> Column:
    """A stand-in for a distance table, from the lengths of the store names."""
    far = half_even(F.abs(F.length(a) - F.length(b)) * F.lit(1.5) + F.lit(1.2), 1)
    return F.when(a == b, F.lit(0.0)).otherwise(far)


def active_listings(listings: DataFrame, store_id: str | None = None) -> DataFrame:
    """Open listings of other stores with their distance, nearest first when shown."""
    open_ones = listings.where(F.col("status") == LISTED)
    if store_id is None:
        return open_ones.withColumn("distance_km", F.lit(0.0))
    others = open_ones.where(F.col("seller_store_id") != store_id)
    return others.withColumn("distance_km", distance(F.lit(store_id), F.col("seller_store_id"))).orderBy("distance_km", "id")


def listings_of(listings: DataFrame, store_id: str) -> DataFrame:
    return listings.where(F.col("seller_store_id") == store_id)


def requests_for(listings: DataFrame, requests: DataFrame, store_id: str) -> DataFrame:
    """Requests on a store's listings."""
    own = listings_of(listings, store_id).select(F.col("id").alias("listing_id")).distinct()
    return skew_join(requests, own, ["listing_id"], spread=["id"]).select(*requests.columns)


def buyer_needs(daily_forecasts: DataFrame, policy: InventoryPolicy = InventoryPolicy()) -> DataFrame:
    """X5, first half: every store and product that is short, decided once per pair."""
    stock = daily_units(daily_forecasts).withColumns(
        {"current_stock": F.lit(BUYER_STOCK).cast("bigint"), "lead_time_days": F.lit(BUYER_LEAD_TIME).cast("bigint")}
    )
    return (
        decide(stock, policy=policy)
        .withColumn("predicted_shortage", F.col("target_stock") - BUYER_STOCK)
        .where(F.col("stock_status").isin(*NEEDY) & (F.col("predicted_shortage") > 0))
        .select(F.col("store_id").alias("buyer_store_id"), "product_id", "predicted_shortage", "stockout_risk")
    )


def match(
    listings: DataFrame, daily_forecasts: DataFrame, *, as_of: date, policy: InventoryPolicy = InventoryPolicy()
) -> DataFrame:
    """Every listing with the stores that need its product, scored and ranked.

    The join is on the product and returns only real matches.  A product may have
    very many listings, so rows of hot products are spread.  Ranking runs per
    listing, whose rows are at most the number of stores.
    """
    pairs = skew_join(listings, buyer_needs(daily_forecasts, policy), ["product_id"], spread=["id"]).where(
        F.col("buyer_store_id") != F.col("seller_store_id")
    )
    risk = F.lit(0)
    for name, points in RISK_SCORE.items():
        risk = F.when(F.col("stockout_risk") == name, points).otherwise(risk)
    urgent = F.when(F.datediff("expiry_date", F.lit(as_of)) <= URGENT_DAYS, URGENT_SCORE).otherwise(0)
    scored = pairs.withColumn("distance_km", distance(F.col("seller_store_id"), F.col("buyer_store_id"))).withColumn(
        "match_score", half_even(risk - F.col("distance_km") * DISTANCE_WEIGHT + urgent, 1)
    )
    ranked = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("match_score"), "buyer_store_id"))
    return scored.select(
        F.col("id").alias("listing_id"),
        "product_id",
        "seller_store_id",
        "buyer_store_id",
        "distance_km",
        "predicted_shortage",
        "stockout_risk",
        F.least("predicted_shortage", "available_qty").alias("recommended_transfer"),
        "match_score",
        ranked.alias("match_rank"),
    )


def apply_requests(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request accepted or refused.

    A request is valid when its listing is open and large enough; the first valid
    one by date and id takes the listing.  The first is found by an aggregate, so
    a listing with very many requests is not gathered.
    """
    offers = listings.select(F.col("id").alias("listing_id"), F.col("status").alias("_status"), F.col("available_qty").alias("_qty"))
    # Written once: the tally of hot listings, the search for the first and the verdict read it.
    rows = materialise(requests, "requests")
    hot = hot_keys(rows, ["listing_id"])
    seen = skew_join(rows, offers, ["listing_id"], spread=["id"], how="left", hot=hot)
    valid = F.coalesce((F.col("_status") == LISTED) & (F.col("requested_qty") <= F.col("_qty")), F.lit(False))
    order = F.struct("requested_on", "id")
    first = seen.where(valid).groupBy("listing_id").agg(F.min(order).alias("_first"))
    judged = skew_join(seen, first, ["listing_id"], spread=["id"], how="left", hot=hot)
    too_late = order > F.col("_first")
    outcome = (
        F.when(F.coalesce(F.col("_status") != LISTED, F.lit(True)) | F.coalesce(too_late, F.lit(False)), "Listing unavailable")
        .when(F.col("requested_qty") > F.col("_qty"), "Requested quantity exceeds available")
        .otherwise("accepted")
    )
    return judged.select(*requests.columns, outcome.alias("outcome"))


def matched_listings(listings: DataFrame, judged: DataFrame) -> DataFrame:
    """Listings after requests: those with an accepted request are MATCHED."""
    # One row per listing, however many requests of one date and id were accepted.
    accepted = judged.where(F.col("outcome") == "accepted").groupBy(F.col("listing_id").alias("id"))
    taken = accepted.agg(F.lit(True).alias("_taken"))
    return listings.join(taken, "id", "left").select(
        *[F.when(F.col("_taken"), MATCHED).otherwise(F.col("status")).alias("status") if c == "status" else c for c in listings.columns]
    )


def fold_transfers(actions: DataFrame, key: str = "transfer_id") -> DataFrame:
    """The state of every transfer after all its actions.

    The machine only moves forward, so its state follows from when each step was
    first possible: the first ACCEPT, the first CONFIRM after it, the first
    COMPLETE after that.  Each is a minimum with map-side combine; actions of a
    transfer are never listed.  Actions out of turn are counted as refused.
    """
    at = F.struct("ts", "event_id")
    rows = materialise(actions.select(key, "ts", "event_id", "action"), "actions")  # every step reads them
    hot = hot_keys(rows, [key])
    moments = rows.where(F.col("action") == STEPS[0][0]).groupBy(key).agg(F.min(at).alias("_t0"))
    for i, (action, _) in enumerate(STEPS[1:], start=1):
        wanted = rows.where(F.col("action") == action)
        after = skew_join(wanted, moments.select(key, f"_t{i - 1}"), [key], spread=["event_id"], hot=hot).where(at > F.col(f"_t{i - 1}"))
        step = after.groupBy(key).agg(F.min(at).alias(f"_t{i}"))
        moments = moments.join(step, key, "left")
    steps = [a for a, _ in STEPS]
    counted = rows.groupBy(key).agg(F.count_if(F.col("action").isin(*steps)).alias("_steps"), F.count(F.lit(1)).alias("actions"))
    out = counted.join(moments, key, "left")
    taken = sum((F.col(f"_t{i}").isNotNull().cast("bigint") for i in range(len(STEPS))), F.lit(0))
    state = F.lit(FIRST_STATE)
    for i, (_, reached) in enumerate(STEPS):
        state = F.when(F.col(f"_t{i}").isNotNull(), reached).otherwise(state)
    return out.select(
        key,
        state.alias("state"),
        "actions",
        (F.col("_steps") - taken).alias("refused"),
        F.col(f"_t{len(STEPS) - 1}.ts").alias("completed_at"),
    )


def listing_status(transfers: DataFrame) -> Column:
    """The listing follows its transfer: COMPLETED at the end, MATCHED before."""
    return F.when(F.col("state") == "COMPLETED", COMPLETED).otherwise(MATCHED)


def movements(transfers: DataFrame) -> DataFrame:
    """Two ledger rows per completed transfer ``(seller_store_id, buyer_store_id, product_id, qty)``."""
    done = transfers.where(F.col("state") == "COMPLETED")
    sides = F.array(
        F.struct(F.col("seller_store_id").alias("store_id"), (-F.col("qty")).alias("change")),
        F.struct(F.col("buyer_store_id").alias("store_id"), F.col("qty").alias("change")),
    )
    return done.select("transfer_id", "product_id", F.inline(sides))


def stock_changes(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*SERIES).agg(F.sum("change").alias("change"))
