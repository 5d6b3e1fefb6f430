from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfcast import session
from shelfcast.operators import validate
from shelfcast.sources.sales import normalise_columns

AS_OF = date(2026, 12, 1)


def frame(spark, sales=(10, 15, 20), days=("2026-08-01", "2026-08-02", "2026-08-03"), repeat=False, kind="bigint"):
    rows = [(d, "P1", "S1", s, 100.0) for d, s in zip(days, sales)]
    if repeat:
        rows.append(rows[0])
    return spark.createDataFrame(rows, f"date string, product_id string, store_id string, sales {kind}, price double")


def findings(df, **options):
    return {r["check"]: r for r in validate.validate(df, min_history=2, as_of=AS_OF, **options).collect()}


def status(df):
    return validate.verdict(validate.validate(df, min_history=2, as_of=AS_OF)).first()["status"]


def test_good_table_passes(spark):
    assert status(frame(spark)) == "PASS"


def test_missing_required_column_fails(spark):
    df = frame(spark).drop("sales")
    assert findings(df)["required_columns"]["message"] == "Missing required columns: sales"
    assert status(df) == "FAIL"


def test_text_sales_fail_and_hold_back_later_checks(spark):
    df = frame(spark, sales=("A", "B", "C"), kind="string").withColumn("target", F.lit(1))
    found = findings(df)
    assert found["sales_numeric"]["severity"] == "ERROR"
    assert "leakage" not in found


def test_a_closed_gate_prepares_nothing_behind_it(spark):
    before = len(session._written)
    found = validate.validate(frame(spark, sales=("A", "5", "6"), kind="string", repeat=True), min_history=2, as_of=AS_OF)
    found.collect()
    made = [path.rsplit("/", 1)[1].split("-")[1] for path in session._written[before:]]
    assert made == ["counts"]
    # Both counts of duplicates read one shuffle of the rows.
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1


def test_duplicates_and_days_of_texts(spark):
    rows = [("2026-08-01", "P", None, 1.0, 2.0)] * 3 + [("2026-08-01", "P", None, 1.0, None), ("8/1/2026", "P", None, 1.0, 2.0)]
    rows += [(None, "P", "S", 1.0, 2.0)] * 2 + [("8/1/2026", "P", "S", 1.0, 2.0), ("2026-08-01", "P", "S", 4.0, 2.0), ("2026-08-21", "P", "S", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "date string, product_id string, store_id string, sales double, price double")
    found = findings(df)
    assert (found["exact_duplicates"]["n"], found["key_duplicates"]["n"]) == (3, 4)
    assert (found["missing_dates"]["scope"], found["missing_dates"]["n"]) == ("P-S", 19)
    assert validate.check_key_duplicates(df).first()["n"] == 4


def test_numbers_in_text_are_fine(spark):
    assert "sales_numeric" not in findings(frame(spark, sales=("1", "2", "3"), kind="string"))


@pytest.mark.parametrize(
    "change, check, words",
    [
        (dict(sales=(-5, 15, 20)), "negative_sales", "1 rows with negative sales"),
        (dict(days=("2099-01-01", "2026-08-02", "2026-08-03")), "future_dates", "1 rows with future dates"),
        (dict(repeat=True), "exact_duplicates", "1 exact duplicate rows"),
        (dict(days=("nonsense", "2026-08-02", "2026-08-03")), "date_format", "unparseable"),
    ],
)
def test_warnings(spark, change, check, words):
    df = frame(spark, **change)
    found = findings(df)
    assert found[check]["severity"] == "WARNING" and words in found[check]["message"]
    assert status(df) == "WARNING"


def test_nan_counts_as_missing(spark):
    df = frame(spark, sales=(float("nan"), 15.0, 20.0), kind="double")
    assert findings(df)["missing_values"]["message"] == "Column 'sales' has 1 missing values (33.33%)."


def test_leakage_and_gap(spark):
    df = frame(spark, days=("2026-08-01", "2026-08-02", "2026-08-20")).withColumn("future_sales", F.lit(1))
    found = findings(df)
    assert found["leakage"]["severity"] == "ERROR"
    assert found["missing_dates"]["n"] == 17 and found["missing_dates"]["scope"] == "P1-S1"


def test_spikes_need_four_values(spark):
    rows = [("A", float(v)) for v in (1, 1, 100)] + [("B", float(v)) for v in (1, 1, 1, 1, 100)]
    df = spark.createDataFrame(rows, "product_id string, sales double")
    assert validate.sales_spikes(df).first()["n"] == 1


def test_normalise_refuses_two_columns_of_one_name(spark):
    df = spark.createDataFrame([(1, 2)], "Quantity int, units_sold int")
    with pytest.raises(ValueError):
        normalise_columns(df)
