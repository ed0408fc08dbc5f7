"""Buckets of orders and lines, and partial aggregates by month: plans and results against the plain tables."""
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from micro import M, NOW
from shelfmetrics.jobs import current, load
from shelfmetrics.plans import QUERIES, dataset
from shelfmetrics.plans.datasets import sold_lines
from shelfmetrics.plans.partials import PARTIALS, from_partials, new_months, of_months, refresh
from shelfmetrics.sources import schema_of
from shelfmetrics.sources.layout import fits_buckets, open_buckets, with_month_of_order, write_buckets, write_table
from test_jobs import write_csvs

DATASETS = ["vw_asof", "vw_monthly_sales", "vw_product_performance", "vw_customer_summary", "vw_inventory_health"]


@pytest.fixture(scope="module")
def by_month(spark, model, tmp_path_factory):
    """Orders and lines of the driver's tables, stored by month."""
    root = str(tmp_path_factory.mktemp("months"))
    write_table(model.sales_orders, f"{root}/sales_orders", "sales_orders")
    write_table(with_month_of_order(model.keyed("sales_order_items"), model.sales_orders), f"{root}/sales_order_items", "sales_order_items")
    return model.with_tables(**{t: spark.read.parquet(f"{root}/{t}") for t in ("sales_orders", "sales_order_items")})


def rows(df):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=str)


def files(root):
    return {(p.parent.parent.name, p.parent.name, p.name) for p in root.rglob("*.parquet")}


@pytest.mark.parametrize("name", DATASETS)
def test_datasets_from_partials_equal_a_full_build(model, partials_of_all, name):
    assert rows(dataset(partials_of_all, name)) == rows(dataset(model, name))


@pytest.fixture(scope="module")
def partials_of_all(by_month, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("partials"))
    assert refresh(by_month, root) == [r[0] for r in by_month.sales_orders.select("stored_month").distinct().orderBy("stored_month").collect()]
    assert new_months(by_month, root) == [] == refresh(by_month, root)
    return from_partials(by_month, root)



def test_a_refresh_reads_its_month_only(spark, micro, tmp_path):
    """One month is added, one changes, one loses its only order; other months are neither read nor written."""
    write_csvs(micro, f"{tmp_path}/csv")
    load(spark, f"{tmp_path}/csv", f"{tmp_path}/lake", "v1", check=False, calendar=("2023-01-01", "2025-12-31"))
    root = tmp_path / "partials"
    refresh(current(spark, f"{tmp_path}/lake"), str(root))
    before = files(root)

    added = spark.createDataFrame([(8, "O8", 3, 1, 1, datetime(2025, 1, 3, 10), "IN_STORE", "COMPLETED", M(42), M(0), M(2), M(42), NOW, NOW)], schema_of("sales_orders"))
    orders = micro.sales_orders.filter("order_id <> 6").withColumn(
        "order_status", F.when(F.col("order_id") == 7, "CANCELLED").otherwise(F.col("order_status"))).unionByName(added)
    lines = micro.sales_order_items.filter("order_id <> 6").unionByName(
        spark.createDataFrame([(8, 8, 6, None, 1, M(42), M(20), M(0), M(42))], schema_of("sales_order_items")))
    write_csvs(micro, f"{tmp_path}/csv2", sales_orders=orders, sales_order_items=lines)
    load(spark, f"{tmp_path}/csv2", f"{tmp_path}/lake", "v2", check=False, calendar=("2023-01-01", "2025-12-31"))
    m = current(spark, f"{tmp_path}/lake")
    assert new_months(m, str(root)) == ["2025-01"]

    changed = ["2023-02", "2024-09", "2025-01"]
    plan = PARTIALS["product_days"][0](of_months(m, changed))._jdf.queryExecution().sparkPlan().toString()
    scans = re.findall(r"FileScan parquet [^\n]*PartitionFilters: \[([^\]]*)\]", plan)
    assert len(scans) == 3 and sum("stored_month" in s for s in scans) == 2, scans  # orders and lines; the third is products
    assert refresh(m, str(root), changed) == changed
    moved = before ^ files(root)
    assert {folder for _, folder, _ in moved} == {f"stored_month={x}" for x in changed}
    for name in DATASETS:
        assert rows(dataset(from_partials(m, str(root)), name)) == rows(dataset(m, name))


def test_a_table_without_months_is_refused(micro, tmp_path):
    with pytest.raises(ValueError, match="not stored by month"):
        refresh(micro, str(tmp_path), ["2024-01"])


@pytest.fixture
def no_broadcast(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.fixture(scope="module")
def bucketed(spark, by_month, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("buckets"))
    out = {}
    for t in ("sales_orders", "sales_order_items"):
        write_buckets(getattr(by_month, t), f"{root}/{t}", t, 8)
        out[t] = open_buckets(spark, f"{root}/{t}", t, 8)
    yield root, by_month.with_tables(**out)
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_lines_join_orders_without_an_exchange(bucketed, no_broadcast):
    lines = sold_lines(bucketed[1])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in lines and "Exchange" not in lines
    assert lines.count("Bucketed: true") == 2
    per_order = sold_lines(bucketed[1]).groupBy("order_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in per_order


@pytest.mark.parametrize("name", ["q16_top_products_by_revenue", "q29_basket_size", "q63_cover_bands", "q205_year_to_date"])
def test_buckets_change_no_result(model, bucketed, name):
    assert rows(QUERIES[name][0](bucketed[1])) == rows(QUERIES[name][0](model))


def test_a_range_of_days_skips_months_of_buckets(bucketed, no_broadcast):
    text = QUERIES["q62_turnover"][0](bucketed[1])._jdf.queryExecution().sparkPlan().toString()
    filters = re.findall(r"FileScan parquet [^\n]*PartitionFilters: \[([^\]]*)\]", text)
    assert sum("stored_month" in f and ">=" in f for f in filters) >= 2, filters


def test_another_session_opens_the_buckets(spark, bucketed, no_broadcast):
    """A catalog that does not know the tables gets them from the path and the number of buckets."""
    root, m = bucketed
    for t in ("sales_orders", "sales_order_items"):
        name = next(x.name for x in spark.catalog.listTables() if x.name.startswith(f"{t}_") and str(root) in
                    spark.sql(f"DESCRIBE EXTENDED {x.name}").filter("col_name = 'Location'").first().data_type)
        spark.sql(f"DROP TABLE {name}")  # external: the files stay
    again = m.with_tables(**{t: open_buckets(spark, f"{root}/{t}", t, 8) for t in ("sales_orders", "sales_order_items")})
    assert "Exchange" not in sold_lines(again)._jdf.queryExecution().executedPlan().toString()
    assert sold_lines(again).count() == sold_lines(m.with_tables(**{t: spark.read.parquet(f"{root}/{t}") for t in ("sales_orders", "sales_order_items")})).count()


def test_load_with_buckets_and_with_a_hot_order(spark, micro, tmp_path):
    write_csvs(micro, f"{tmp_path}/csv")
    load(spark, f"{tmp_path}/csv", f"{tmp_path}/lake", "v1", check=False, calendar=("2023-01-01", "2024-12-31"), buckets=2)
    text = sold_lines(current(spark, f"{tmp_path}/lake"))._jdf.queryExecution().executedPlan().toString()
    assert "buckets" in text.lower() and dataset(current(spark, f"{tmp_path}/lake"), "vw_sales_lines").count() == 6
    hot = micro.sales_order_items.withColumn("order_id", F.when(F.col("order_item_id") < 6, 1).otherwise(F.col("order_id")))
    assert not fits_buckets(hot, "sales_order_items", 2) and fits_buckets(micro.sales_order_items, "sales_order_items", 2)
    write_csvs(micro, f"{tmp_path}/csv2", sales_order_items=hot)
    load(spark, f"{tmp_path}/csv2", f"{tmp_path}/lake", "v2", check=False, calendar=("2023-01-01", "2024-12-31"), buckets=2)
    assert spark.read.json(f"{tmp_path}/lake/_published").filter("version = 'v2'").select("buckets").first().buckets is None
    assert current(spark, f"{tmp_path}/lake").sales_order_items.count() == 7
