"""The same comparison on skewed tables: one order, one customer, one product and one e-mail-like key hold a third of the rows."""
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from compare import connect, differences

NAMES = [
    "q05_order_value", "q16_top_products_by_revenue", "q28_promotion_uplift", "q29_basket_size", "q38_new_and_returning", "q39_rfm_scores",
    "q41_cohort_retention", "q45_days_between_orders", "q46_revenue_deciles", "q48_category_bestseller", "q52_abc_products", "q53_concentration",
    "q56_bought_together", "q60_health_summary", "q64_movement_classes", "q88_supplier_score", "q96_days_to_return", "q106_trading_streaks",
    "q107_top_products_per_store", "q110_value_percentiles", "q113_first_purchase", "q114_reactivated", "q115_second_order", "q204_three_months_running",
    "q208_rising_orders", "q301_scorecard", "q303_duplicate_products", "q306_ledger_mismatch", "q307_extreme_quantities", "q504_correlated_average",
    "vw_product_performance", "vw_customer_summary", "vw_inventory_health", "vw_monthly_sales", "integrity_counts", "measures_by_category"]


@pytest.fixture(scope="module")
def skewed_dir(sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    for t in ("region", "nation", "customer", "supplier", "part", "events"):
        shutil.copy(f"{sf_dir}/{t}.parquet", out / f"{t}.parquet")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2000-06-01' ELSE o_orderdate END AS o_orderdate,
        CASE WHEN o_orderkey % 4 = 0 THEN 150000.0 ELSE o_totalprice END AS o_totalprice) FROM '{sf_dir}/orders.parquet') TO '{out}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT * EXCLUDE (n) REPLACE (CASE WHEN n % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN n % 3 = 1 THEN 5 ELSE l_partkey END AS l_partkey) FROM (SELECT *, row_number() OVER () AS n FROM '{sf_dir}/lineitem.parquet'))
        TO '{out}/lineitem.parquet' (FORMAT parquet)""")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_skewed_tables_match(spark, skewed_dir, name):
    assert differences(entry.queries()[name](spark, skewed_dir), connect(skewed_dir), entry.oracle_sql()[name]) == []
