"""Load, build, export and layout jobs, end to end on the micro tables."""
import re

import pytest
from pyspark.sql import functions as F

from micro import ROWS
from shelfmetrics.jobs import EXPORTS, LOAD_ORDER, RejectedLoad, build, current, export_all, last_published, load, malformed, publish, split_rejected
from shelfmetrics.plans import dataset
from shelfmetrics.sources import schema_of


def write_csvs(m, folder, **changed):
    for t in LOAD_ORDER:
        changed.get(t, getattr(m, t)).write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/{t}.csv")


@pytest.fixture(scope="module")
def loaded(spark, micro, tmp_path_factory):
    base = tmp_path_factory.mktemp("load")
    write_csvs(micro, f"{base}/csv")
    load(spark, f"{base}/csv", f"{base}/lake", "v1", calendar=("2023-01-01", "2024-12-31"))
    return base


def test_load_keeps_rows_and_types(spark, loaded):
    m = current(spark, f"{loaded}/lake")
    for t in LOAD_ORDER:
        assert getattr(m, t).count() == len(ROWS[t])
    assert dict(m.products.dtypes)["unit_cost"] == "decimal(12,2)" and m.customers.filter("email is null").count() == 1
    assert m.dim_date.count() == 731


def test_datasets_agree_on_loaded_tables(spark, micro, loaded):
    m = current(spark, f"{loaded}/lake")
    for name in ("vw_monthly_sales", "vw_sales_lines"):
        a, b = dataset(m, name), dataset(micro, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_rejected_load_leaves_the_old_version(spark, micro, loaded, tmp_path):
    bad = micro.sales_orders.withColumn("total_amount", F.when(F.col("order_id") == 1, -1).otherwise(F.col("total_amount")).cast("decimal(12,2)"))
    write_csvs(micro, f"{tmp_path}/csv", sales_orders=bad)
    with pytest.raises(RejectedLoad, match="total_amount >= 0"):
        load(spark, f"{tmp_path}/csv", f"{loaded}/lake", "v2")
    assert current(spark, f"{loaded}/lake").sales_orders.filter("total_amount < 0").count() == 0
    split_rejected(micro.with_tables(sales_orders=bad), "sales_orders", f"{tmp_path}/good", f"{tmp_path}/bad")
    assert (spark.read.parquet(f"{tmp_path}/good").count(), spark.read.parquet(f"{tmp_path}/bad").count()) == (6, 1)


def test_layout_is_used_by_lookups(spark, loaded):
    from shelfmetrics.plans import QUERIES
    m = current(spark, f"{loaded}/lake")

    def plan(name, **options):
        return QUERIES[name][0](m, **options)._jdf.queryExecution().toString()

    assert "PartitionFilters: [isnotnull(status" in plan("q508_open_purchases")
    assert "PartitionFilters: [isnotnull(store_id" in plan("q506_position_ledger")
    assert "EqualTo(email_norm,kiran@x.com)" in plan("q509_email_lookup", email="Kiran@x.com")


@pytest.mark.parametrize("name,options,tables", [
    ("q502_month_revenue", {"first": "2024-02-01", "until": "2024-03-01"}, ["sales_orders"]), ("q510_store_quarter", {"first": "2024-01-01", "until": "2024-04-01"}, ["sales_orders"]),
    ("q205_year_to_date", {"year": 2024}, ["sales_orders"]), ("q105_days_without_sales", {"first": "2024-02-01", "last": "2024-02-28"}, ["sales_orders"]),
    ("q62_turnover", {}, ["sales_orders", "sales_order_items"]), ("q63_cover_bands", {}, ["sales_orders", "sales_order_items"])])
def test_days_skip_months(spark, micro, loaded, name, options, tables):
    """A range of days, or of days before the last order, reads the folders of its months only, of orders and of lines; the result is that of the plain tables."""
    from shelfmetrics.plans import QUERIES
    df = QUERIES[name][0](current(spark, f"{loaded}/lake"), **options)
    assert sorted(map(str, df.collect())) == sorted(map(str, QUERIES[name][0](micro, **options).collect()))
    scans = re.findall(r"FileScan parquet [^\n]*PartitionFilters: \[([^\]]*)\][^\n]*", df._jdf.queryExecution().sparkPlan().toString())
    assert sum("stored_month" in f and (">=" in f) for f in scans) >= len(tables), scans


def test_records_that_do_not_parse_are_kept_apart(spark, micro, loaded, tmp_path):
    write_csvs(micro, f"{tmp_path}/csv")
    folder = f"{tmp_path}/csv/payments.csv"
    first = spark.read.text(folder).filter("value LIKE '1,%'").first().value.split(",")
    with open(f"{folder}/more.csv", "w") as f:
        header = ",".join(micro.payments.columns)
        f.write("\n".join([header, ",".join(["x", *first[1:]]), ",".join(first[:2]), ",".join(["77", *first[1:]])]) + "\n")
    with pytest.raises(RejectedLoad, match="payments: does not parse \\(2 rows\\)"):
        load(spark, f"{tmp_path}/csv", f"{tmp_path}/lake", "v1", check=False)
    assert last_published(spark, f"{tmp_path}/lake") == 0
    load(spark, f"{tmp_path}/csv", f"{tmp_path}/lake", "v2", check=False, calendar=("2023-01-01", "2024-12-31"), keep_malformed=True)
    bad = malformed(spark, f"{tmp_path}/lake", "v2").collect()
    assert {(r.table_name, r.file.rsplit("/", 1)[1], r.record) for r in bad} == {("payments", "more.csv", ",".join(["x", *first[1:]])), ("payments", "more.csv", ",".join(first[:2]))}
    assert current(spark, f"{tmp_path}/lake").payments.count() + len(bad) == micro.payments.count() + 3


def test_one_of_two_writers_wins(spark, tmp_path):
    place = last_published(spark, str(tmp_path)) + 1
    publish(spark, str(tmp_path), "mine", place)
    with pytest.raises(RejectedLoad, match="since theirs began"):
        publish(spark, str(tmp_path), "theirs", place)
    publish(spark, str(tmp_path), "next", last_published(spark, str(tmp_path)) + 1)
    log = spark.read.json(f"{tmp_path}/_published").select("version", "_metadata.file_name").collect()
    assert sorted(map(tuple, log)) == [("mine", "00000001.json"), ("next", "00000002.json")]
    (tmp_path / "_published" / "00000003.json").touch()  # a writer that has not ended
    assert spark.read.schema("version string").json(f"{tmp_path}/_published").count() == 2


def test_lines_lie_beside_their_orders(spark, micro, loaded):
    m = current(spark, f"{loaded}/lake")
    assert m.sales_order_items.join(m.sales_orders, ["order_id", "stored_month"]).count() == micro.sales_order_items.count() == m.sales_order_items.count()


def test_build_and_export(spark, micro, tmp_path):
    build(micro, f"{tmp_path}/datasets", ["vw_customer_summary", "vw_asof"])
    assert spark.read.parquet(f"{tmp_path}/datasets/vw_customer_summary").count() == 4
    manifest = {r.file: r for r in export_all(micro, f"{tmp_path}/star").collect()}
    assert set(manifest) == set(EXPORTS) and len(manifest) == 13
    assert manifest["fact_sales_lines"].rows == 6 and manifest["dim_date"].rows == 717
    lines = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/star/fact_sales_lines")
    assert lines.count() == 6 and lines.filter("promoted = 'Promoted'").count() == 1
    assert "email" not in spark.read.option("header", True).csv(f"{tmp_path}/star/dim_customer").columns


def test_schemas_cover_the_model():
    assert len(LOAD_ORDER) == 18 and [f.name for f in schema_of("product_promotions")] == ["promotion_id", "product_id"]
