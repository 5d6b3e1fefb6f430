import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from shelfcast.operators import access, exchange

DAY = date(2026, 1, 10)
LISTING = "id string, seller_store_id string, product_id string, available_qty bigint, price_per_unit double, expiry_days int, created_on date, status string"


def listings(spark, *rows):
    return exchange.create_listings(spark.createDataFrame(list(rows), LISTING))


def test_listing_defaults_and_expiry(spark):
    a, b = listings(spark, ("l1", "S1", "P", 5, 1.0, 3, DAY, None), ("l2", "S1", "P", 5, 1.0, 0, DAY, "MATCHED")).orderBy("id").collect()
    assert (a.status, a.min_qty, a.expiry_date) == ("LISTED", 1, DAY + timedelta(days=3))
    assert b.expiry_date is None


def test_active_listings_leave_out_own_and_sort_by_distance(spark):
    df = listings(spark, ("a", "LONGNAME", "P", 1, 1.0, None, DAY, "LISTED"), ("b", "S2", "P", 1, 1.0, None, DAY, "LISTED"), ("c", "S1", "P", 1, 1.0, None, DAY, "LISTED"), ("d", "S3", "P", 1, 1.0, None, DAY, "COMPLETED"))
    assert [(r.id, r.distance_km) for r in exchange.active_listings(df, "S1").collect()] == [("b", 1.2), ("a", 10.2)]


def demand(spark, **totals):
    rows = [(s, "P", date(2026, 1, 1) + timedelta(days=i), t) for s, t in totals.items() for i in range(7)]
    return spark.createDataFrame(rows, "store_id string, product_id string, date date, predicted_demand bigint")


def test_matching(spark):
    offers = listings(spark, ("l1", "S1", "P", 8, 1.0, 2, DAY, "LISTED"), ("l2", "S2", "P", 500, 1.0, None, DAY, "LISTED"), ("l3", "S1", "Q", 5, 1.0, None, DAY, "LISTED"))
    found = exchange.match(offers, demand(spark, S1=10, S2=4, FARAWAY=10, S9=0), as_of=DAY)
    rows = {(r.listing_id, r.buyer_store_id): r for r in found.collect()}
    assert set(rows) == {("l1", "S2"), ("l1", "FARAWAY"), ("l2", "S1"), ("l2", "FARAWAY")}
    near = rows[("l1", "S2")]
    assert (near.recommended_transfer, near.distance_km) == (8, 1.2)
    assert near.match_score == 50 - 2.4 + 40 and near.match_rank == 1
    assert rows[("l2", "S1")].match_score == 50 - 2.4


def test_matching_with_a_hot_product_is_whole(spark):
    n = 400
    offers = spark.range(n).select(
        F.concat(F.lit("l"), "id").alias("id"),
        F.lit("S1").alias("seller_store_id"),
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("Q"), "id")).otherwise("P").alias("product_id"),
        F.lit(5).cast("bigint").alias("available_qty"),
        F.lit(None).cast("date").alias("expiry_date"),
    )
    found = exchange.match(offers, demand(spark, S1=10, S2=10, S3=10), as_of=DAY)
    assert found.count() == found.select("listing_id", "buyer_store_id").distinct().count() == 300 * 2


def test_first_valid_request_takes_the_listing(spark):
    offers = listings(spark, ("l1", "S1", "P", 10, 1.0, None, DAY, "LISTED"), ("l2", "S1", "P", 10, 1.0, None, DAY, "MATCHED"))
    asked = spark.createDataFrame(
        [("t1", "l1", 50, date(2026, 1, 1)), ("t2", "l1", 5, date(2026, 1, 3)), ("t3", "l1", 5, date(2026, 1, 2)), ("t4", "l2", 1, date(2026, 1, 1)), ("t5", "nowhere", 1, date(2026, 1, 1)), ("t6", "l1", 99, date(2026, 1, 5))],
        "id string, listing_id string, requested_qty bigint, requested_on date",
    )
    judged = exchange.apply_requests(offers, asked)
    got = {r.id: r.outcome for r in judged.collect()}
    gone = "Listing unavailable"
    assert got == {"t1": "Requested quantity exceeds available", "t2": gone, "t3": "accepted", "t4": gone, "t5": gone, "t6": gone}
    assert {r.id: r.status for r in exchange.matched_listings(offers, judged).collect()} == {"l1": "MATCHED", "l2": "MATCHED"}


def actions_table(spark, seed=5, n=60, hot=200):
    rng = random.Random(seed)
    names = ["ACCEPT", "CONFIRM", "COMPLETE", "REJECT", "SHIP", "REQUEST"]
    rows, i = [], 0
    for k in range(n):
        for _ in range(hot if k == 0 else rng.randint(1, 8)):
            rows.append((f"t{k}", datetime(2026, 1, 1) + timedelta(minutes=rng.randint(0, 500)), i, rng.choice(names)))
            i += 1
    return rows, spark.createDataFrame(rows, "transfer_id string, ts timestamp, event_id bigint, action string")


def fold_by_hand(rows):
    state = {}
    for key, _, _, action in sorted(rows, key=lambda r: (r[1], r[2])):
        now = state.setdefault(key, "REQUESTED")
        state[key] = exchange.TRANSITIONS.get((now, action), now)
    return state


def test_states_agree_with_a_plain_loop(spark):
    rows, df = actions_table(spark)
    folded = exchange.fold_transfers(df).collect()
    assert {r.transfer_id: r.state for r in folded} == fold_by_hand(rows)
    assert all((r.completed_at is not None) == (r.state == "COMPLETED") for r in folded)


def test_movements_cancel_out(spark):
    done = spark.createDataFrame(
        [("t1", "COMPLETED", "A", "B", "P", 4), ("t2", "ACCEPTED", "A", "B", "P", 9), ("t3", "COMPLETED", "B", "A", "P", 1)],
        "transfer_id string, state string, seller_store_id string, buyer_store_id string, product_id string, qty bigint",
    )
    got = {r.store_id: r.change for r in exchange.stock_changes(exchange.movements(done)).collect()}
    assert got == {"A": -3, "B": 3}


def test_access(spark):
    rows = spark.createDataFrame([("store_01", 1), ("store_02", 2)], "store_id string, v int")
    users = spark.createDataFrame(
        [("boss", "ADMIN", None), ("staff", "STAFF", "store_01"), ("two", "STAFF", "store_09, store_02"), ("any", "STAFF", "*"), ("none", "STAFF", None), ("blank", "STAFF", "")],
        "user string, role string, authorized_stores string",
    )

    def sees(user):
        return sorted(r.v for r in access.restrict(rows, users, user).collect())

    assert [sees(u) for u in ("boss", "staff", "two", "any", "none", "blank", "unknown")] == [[1, 2], [1], [2], [1, 2], [], [], []]
