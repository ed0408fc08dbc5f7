"""Plan shape: filters reach the scan, columns are pruned, no nested loops, group limits before the shuffle."""
import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if re.match(r"q\d+_|vw_", n)])
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("name,pushed", [
    ("q501_customer_history", "EqualTo(o_custkey,42)"), ("q502_month_revenue", "GreaterThanOrEqual(o_orderdate,2000-10-01T00:00)"),
    ("q503_product_lines", "EqualTo(l_partkey,13)"), ("q514_order_returns", "EqualTo(l_returnflag,R)"), ("q515_order_payments", "EqualTo(o_orderkey,200)")])
def test_filters_reach_the_scan(spark, sf_dir, name, pushed):
    assert pushed in plan(QUERIES[name](spark, sf_dir))


def test_columns_are_pruned(spark, sf_dir):
    text = plan(QUERIES["q511_full_scan"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in text
    assert "row_index" not in plan(QUERIES["q16_top_products_by_revenue"](spark, sf_dir))


@pytest.mark.parametrize("name", ["q54_best_margins", "q107_top_products_per_store", "q207_top_with_ties", "q208_rising_orders"])
def test_group_limit_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf_dir))


def test_measures_join_only_the_dimensions_they_use(spark, sf_dir):
    text = plan(QUERIES["measures_by_category"](spark, sf_dir))
    assert "customer.parquet" not in text and "nation.parquet" not in text and "lineitem.parquet" in text


def test_integrity_reads_the_ledger_once(spark, sf_dir):
    """Orders meet the header, line, purchase and return rules only; movements come from one stored placement."""
    text = plan(QUERIES["integrity_report"](spark, sf_dir))
    scans = {t: len(re.findall(rf"FileScan parquet[^\n]*{t}[.]parquet", text)) for t in ("lineitem", "orders", "part")}
    assert scans["lineitem"] <= 9 and scans["orders"] <= 5 and scans["part"] <= 3


def test_reused_features_cover_the_survey():
    """Each construct of the query inventory is used by at least one registered query."""
    numbers = {int(m.group(1)) for m in (re.match(r"q(\d+)_", n) for n in QUERIES) if m}
    wanted = set(range(1, 116)) | set(range(201, 215)) | set(range(301, 310)) | set(range(401, 405)) | set(range(501, 518))
    assert wanted - numbers == set()


def test_pairs_are_counted_where_the_lines_meet(spark, sf_dir):
    """The lines of a small basket are listed by a window; only large baskets are joined by blocks."""
    text = plan(QUERIES["q56_bought_together"](spark, sf_dir))
    assert "collect_list(" in text and "LeftAnti" in text


def test_trailing_lines_are_read_with_all_lines(spark, model):
    from shelfmetrics.plans.measures import measures
    text = plan(measures(model, ["cogs", "cogs_last_12m", "refunded_net_of_gst", "refunded_net_of_gst_by_return_date"]))
    once = plan(measures(model, ["cogs", "refunded_net_of_gst"]))
    assert text.count("lineitem.parquet") == once.count("lineitem.parquet")


def test_buyers_meet_the_order_before_returned_lines(spark, sf_dir):
    lines = QUERIES["vw_return_analysis"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+-]*", line).group(0)) for line in lines]
    at = next(i for i, line in enumerate(lines) if re.search(r"Join Inner, \(customer_id", line))
    under = [line for line, n in zip(lines[at + 1:], depth[at + 1:]) if all(k > depth[at] for k in depth[at + 1:lines.index(line, at + 1) + 1])]
    assert any("c_custkey" in line for line in under) and not any("l_orderkey" in line for line in under)


def test_checks_meet_lines_with_orders_once(spark, sf_dir):
    """The lines left in the plan are those of returns: the return, its item and the sold line; sales come from the stored table."""
    text = plan(QUERIES["validation_checks"](spark, sf_dir))
    assert len(re.findall(r"FileScan parquet[^\n]*lineitem[.]parquet", text)) <= 5


def test_orders_are_counted_where_lines_lie_by_order(spark, model):
    """Goods meet the line before its order, so that the distinct orders of a category need no shuffle of their own."""
    from shelfmetrics.plans.measures import measures
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(measures(model, ["net_revenue", "orders_line_basis"], ["category"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "hashpartitioning(order_id#" in text and not re.search(r"hashpartitioning[(]category#\d+, order_id#", text)


def test_returns_meet_the_sale_before_returned_lines(spark, model):
    from shelfmetrics.plans.measures import measures
    text = measures(model, ["units_returned", "refunded_net_of_gst"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [m.group(1) for m in re.finditer(r"Join Inner, \((\w+)#", text)]
    assert joins.index("return_id") < joins.index("order_id")


def test_sales_meet_orders_once_for_all_sums(spark, model, micro):
    """Groups of lines, classes of products and demand of positions come from one pass over the lines, with the results that each has alone."""
    from shelfmetrics.plans.measures import measures
    names = ["net_revenue", "units_sold", "orders_line_basis", "cogs_last_12m", "class_a_products", "product_revenue", "dead_stock_positions", "low_stock_positions"]
    assert "lineitem.parquet" not in plan(measures(model, names)) and "lineitem.parquet" not in plan(measures(model, names, ["category"]))
    for m in (model, micro, micro.with_tables(sales_order_items=micro.sales_order_items.filter("false"))):
        for keys in ([], ["category"]):
            together = {tuple(r[k] for k in keys): r for r in measures(m, names, keys).collect()}
            for n in names:
                for r in measures(m, [n], keys).collect():
                    assert together[tuple(r[k] for k in keys)][n] == (pytest.approx(float(r[n])) if isinstance(r[n], float) else r[n]), (n, keys)


def test_customer_measures_need_no_ordering(spark, model):
    """Only the summary's spending score orders all buyers, and no measure reads it."""
    from shelfmetrics.plans.measures import measures
    names = ["total_customers", "orders_with_returns", "completed_orders", "new_customers", "buying_customers"]
    assert "_slice" not in plan(measures(model, names))
    assert measures(model, names).first() == tuple(measures(model, [n]).first()[0] for n in names)
