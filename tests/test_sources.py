from datetime import date, timedelta

import pytest

from shelfcast.operators import overview
from shelfcast.session import ensure_checkpoint_dir, materialise
from shelfcast.sources import reports, sales


def rows(spark, n=100):
    start = date(2026, 1, 1)
    return spark.createDataFrame(
        [(start + timedelta(days=i), "A" if i % 2 else "B c", f"P{i % 3}", float(i)) for i in range(n)],
        "date date, store_id string, product_id string, sales double",
    )


def test_csv_comes_as_text(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("Date,Location,Product_Name,Quantity\n2026-01-01,S,P,3\nbad,S,P,x\n")
    df = sales.normalise_columns(sales.scan_sales(spark, path))
    assert df.columns == ["date", "store_id", "product_id", "sales"] and {t for _, t in df.dtypes} == {"string"}


def test_recent_slice_includes_both_ends(spark):
    got = sales.recent_slice(rows(spark), 60).select("date").distinct().count()
    assert got == 61


def test_reports_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    made = rows(spark)
    reports.write_reports(made, path)
    found = reports.read_report(spark, path, made.schema, store_id="B c", product_id="P0")
    want = made.where("store_id = 'B c' and product_id = 'P0'")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert reports.read_report(spark, path, made.schema, store_id="A", product_id="none").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(store" in plan


def test_snapshot_round_trip(spark, tmp_path):
    path = str(tmp_path / "s")
    reports.write_reference_snapshot(rows(spark), path)
    assert sorted(map(str, reports.read_reference_snapshot(spark, path).select(*rows(spark).columns).collect())) == sorted(map(str, rows(spark).collect()))


def test_written_tables_go_to_the_checkpoint_folder(spark):
    folder = ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured in (None, folder) and spark.sparkContext.getCheckpointDir() is not None
    made = materialise(rows(spark), "x")
    assert made.count() == 100 and all(f"{folder.rstrip('/')}/shelfcast-x-" in f for f in made.inputFiles())


def test_overview(spark):
    df = rows(spark)
    assert overview.dimension_counts(df).first().asDict() == {"stores": 2, "products": 3}
    p = overview.profile(df).first()
    assert (p["rows"], p.stores, p.products, p.mean_sales, p.total_sales) == (100, 2, 3, 49.5, 4950.0)
    assert [r.sales for r in overview.history(df, store_id="A", product_id="P0").limit(2).collect()] == [3.0, 9.0]


def test_unknown_scope_is_refused(spark):
    from shelfcast.operators.clean import densify

    with pytest.raises(ValueError):
        densify(rows(spark), scope="some")
