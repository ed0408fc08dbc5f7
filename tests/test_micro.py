"""Semantics the driver's tables cannot show: NULLs, case variants, ties, planted defects."""
import pytest
from pyspark.sql import functions as F

from micro import M
from shelfmetrics.plans import QUERIES, analysis, dataset
from shelfmetrics.plans.datasets import with_stored_sales
from shelfmetrics.plans.integrity import integrity_report, load_report, negative_balances, running_balances, stored_ledger
from shelfmetrics.plans.measures import measures
from shelfmetrics.plans.quality import null_profile
from shelfmetrics.plans.validation import gate, report, run_checks
from shelfmetrics.sources import Retail, append_missing, build_calendar
from shelfmetrics.sources.validate import validate, violation_counts


def run(m, name, **options):
    return QUERIES[name][0](m, **options)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_category_variants_are_merged(micro):
    c = by(dataset(micro, "vw_category_canonical"), "category_id")
    assert (c[5].canonical_id, c[5].canonical_name, c[3].parent_category) == (4, "Footwear", "Mobiles")
    assert rows(run(micro, "q309_category_variants")) == [("footwear", "Footwear (id 4, 1 products) ; FOOTWEAR (id 5, 1 products)")]


def test_gst_is_taken_from_the_product_when_lines_have_none(micro):
    line = by(dataset(micro, "vw_sales_lines"), "order_item_id")
    assert round(line[1].net_revenue, 2) == 1000 and round(line[2].net_revenue, 2) == 200
    assert line[6].category_name == "(no category)" and 5 not in line


def test_labels_for_missing_values(micro):
    p = by(dataset(micro, "vw_product_performance"), "product_id")
    assert (p[2].brand, p[5].category, p[4].supplier) == ("(brand missing)", "(no category)", "(supplier missing)")
    assert p[6].abc_class == "No sales" and p[6].margin_pct is None
    c = by(dataset(micro, "vw_customer_summary"), "customer_id")
    assert (c[1].customer_name, c[2].customer_name, c[3].segment) == ("Amit Shah", "Neha ", "(no segment)")
    assert (c[4].activity_status, c[4].rfm_segment, c[4].orders) == ("Never purchased", None, 0)


def test_monthly_spine_keeps_empty_months(micro):
    months = by(dataset(micro, "vw_monthly_sales"), "year_month")
    assert len(months) == 24 and months["2023-06"].orders == 0 and months["2023-06"].avg_order_value is None
    assert months["2024-12"].cancelled_orders == 1 and months["2023-01"].refunded_net == 1000


def test_inventory_health_first_match(micro):
    h = {r.inventory_id: r.health_status for r in dataset(micro, "vw_inventory_health").collect()}
    assert h == {1: "LOW_STOCK", 2: "DEAD_STOCK", 3: "OUT_OF_STOCK", 4: "DEAD_STOCK", 5: "DEAD_STOCK"}


def test_supplier_dataset(micro):
    s = by(dataset(micro, "vw_supplier_performance"), "supplier_id")
    assert (s[1].on_time_pct, s[2].open_pos, s[2].overdue_pos, s[3].missing_contact_info, s[3].total_pos) == (50.0, 1, 1, True, 0)


def test_scorecard_finds_the_planted_defects(micro):
    score = by(run(micro, "q301_scorecard", run_day=F.lit("2025-01-01").cast("date")), "check_id")
    found = {k: r.issue_count for k, r in score.items() if r.issue_count}
    assert found == {
        "DQ01": 1, "DQ02": 1, "DQ03": 1, "DQ04": 2, "DQ05": 1, "DQ06": 1, "DQ07": 2, "DQ08": 1, "DQ09": 1, "DQ10": 1, "DQ11": 1, "DQ12": 1, "DQ13": 1,
        "DQ14": 1, "DQ18": 1, "DQ20": 2, "DQ21": 1, "DQ22": 1, "DQ23": 2, "DQ24": 1, "DQ27": 2, "DQ28": 1, "DQ29": 1}
    assert score["DQ24"].status == "INFO" and score["DQ30"].status == "PASS" and score["DQ01"].status == "ATTENTION"


def test_quality_details(micro):
    assert rows(run(micro, "q302_duplicate_groups")) == [("a@x.com", 2, 1, "AMIT"), ("a@x.com", 2, 2, "neha ")]
    assert rows(run(micro, "q303_duplicate_products"), "records", "first_product", "product_id") == [(2, 3, 3), (2, 3, 4)]
    assert by(run(micro, "q304_null_profile"), "column_name")["date_of_birth"].null_count == 1
    assert rows(run(micro, "q202_duplicate_customers"), "customer_id") == [(2,)]
    assert rows(run(micro, "q308_unpaid_by_store")) == [("Pune", 1, 21)]
    assert by(null_profile(micro.products, ("brand", "sku")), "column_name")["brand"].null_pct == pytest.approx(16.67)


def test_integrity_report(micro):
    broken = {r.rule for r in integrity_report(micro).collect() if r.violations}
    assert broken == {
        "line total = quantity x price - discount", "order header = sum of lines", "order after registration", "order after store opening", "payments = order total",
        "returns on completed orders, after the order", "running ledger balance >= 0", "ledger = stock on hand", "sold units = sale movements"}
    assert rows(negative_balances(micro), "transaction_id") == [(3,)]
    assert not any(r.passed for r in load_report(micro, {"customers": 5000}).collect() if "customers" in r.rule)


def test_return_items_without_a_header_count_as_returned(spark, micro):
    items = micro.return_items.union(spark.createDataFrame([(3, 99, 1, 50, M(0), False)], micro.return_items.schema))
    found = {r.rule: r.violations for r in integrity_report(Retail(spark, micro._tables | {"return_items": items})).collect()}
    assert found["returned <= sold"] == 1
    assert found["return item belongs to the order"] == 0


def test_not_in_trap(micro):
    assert rows(run(micro, "q211_not_in_trap")) == [(0, 0)]
    assert rows(run(micro, "q34_never_purchased")) == [(1, 1, 1)]


def test_never_sold_two_definitions(micro):
    assert sorted(rows(run(micro, "q49_never_sold"), "product_id")) == [(4,), (6,)]


def test_reference_defaults_run_on_reference_years(micro):
    assert rows(run(micro, "q104_customer_sets"), "customers") == [(0,), (2,), (0,)]
    assert rows(run(micro, "q28_promotion_uplift"), "promo_code", "units_during", "units_28d_before") == [("DIWALI", 2, 1)]
    days = rows(run(micro, "q105_days_without_sales", first="2024-10-04", last="2024-10-06"))
    assert [d[1] for d in days] == ["Fri", "Sun"]
    assert rows(run(micro, "q103_category_mismatch"), "category", "match_type") == [
        ("Electronics", "Category without sales"), ("FOOTWEAR", "Category without sales"), ("(products with NO category)", "Sales without a category")]


def test_staff(micro):
    assert rows(run(micro, "q209_hired_before_manager"), "employee", "manager") == [("Old Hand", "Ravi Rao")]
    best = by(run(micro, "q77_best_salesperson"), "store_name")
    assert (best["Lucknow"].top_employee, best["Lucknow"].reports_to) == ("Ravi Rao", None)
    assert by(run(micro, "q102_reporting_depth"), "store_name")["Lucknow"].max_depth == 3


def test_time_of_day_slots(micro):
    assert rows(run(micro, "q21_time_slots"), "time_slot", "orders") == [
        ("1) Morning (10-12)", 3), ("2) Afternoon (12-16)", 1), ("3) Evening (16-19)", 1), ("4) Night (19-22)", 1)]


def test_days_to_return_keeps_the_fraction(micro):
    assert by(dataset(micro, "vw_return_analysis"), "return_id")[1].days_to_return == 5.5


def test_rewritten_query_equals_the_correlated_one(micro):
    a, b = (sorted(rows(run(micro, q, floor=100, times=1))) for q in ("q504_correlated_average", "q517_preaggregated_average"))
    assert a == b and len(a) == 3


def test_validator_accepts_and_rejects(spark, micro):
    good, bad = validate(micro, "sales_orders")
    assert good.count() == 7 and bad.count() == 0
    broken = micro.with_tables(
        sales_order_items=micro.sales_order_items.union(spark.createDataFrame(
            [(8, 404, 1, None, 0, None, M(1), M(0), M(0)), (1, 1, 2, 77, 1, M(1), M(1), M(0), M(-1))],
            "a int, b int, c int, d int, e int, f decimal(12,2), g decimal(12,2), h decimal(12,2), i decimal(12,2)")))
    why = {r.rule for r in violation_counts(broken, ["sales_order_items"]).collect()}
    assert why == {"unit_price is null", "quantity > 0", "line_total >= 0", "duplicate order_item_id", "order_id has no parent in sales_orders",
                   "promotion_id has no parent in promotions"}
    assert validate(broken, "sales_order_items")[0].count() == 6


def test_calendar_insert_if_absent(spark):
    old, new = build_calendar(spark, "2024-12-30", "2025-01-02"), build_calendar(spark, "2025-01-01", "2025-01-05")
    assert append_missing(old, new, ["date_key"]).count() == 3
    day = by(old, "date_key")
    assert [(r.week_of_year, r.day_name, r.is_weekend) for r in day.values()][0] == (1, "Monday", False)


def test_measures_in_context(micro):
    total = measures(micro, ["net_revenue", "completed_orders", "stock_positions", "period_label"]).first()
    assert (round(total.net_revenue), total.completed_orders, total.stock_positions, total.period_label) == (4519, 6, 5, "15 Jan 2023 to 31 Dec 2024")
    years = by(measures(micro, ["net_revenue", "net_revenue_yoy_pct", "stock_positions", "buying_customers"], ["year"]), "year")
    assert years[2024].net_revenue_yoy_pct == pytest.approx(years[2024].net_revenue / years[2023].net_revenue - 1)
    assert {r.stock_positions for r in years.values()} == {5}
    sliced = measures(micro, ["net_revenue", "completed_orders"], filters={"region": ["West"], "year": [2024]}).first()
    assert (round(sliced.net_revenue), sliced.completed_orders) == (500, 1)
    # A category reaches lines and stock, not orders.
    cats = by(measures(micro, ["units_sold", "completed_orders", "units_on_hand"], ["category"]), "category")
    assert cats["Footwear"].units_sold == 1 and {r.completed_orders for r in cats.values()} == {6}
    with pytest.raises(KeyError):
        measures(micro, ["no_such_measure"])
    with pytest.raises(ValueError):
        measures(micro, ["net_revenue_py"], ["region"])


def test_three_month_average_divides_by_three(micro):
    m = {str(r.month): r for r in measures(micro, ["net_revenue", "net_revenue_3m_avg", "net_revenue_pm", "net_revenue_running_total"], ["month"]).collect()}
    assert m["2023-01-01"].net_revenue_3m_avg == pytest.approx(m["2023-01-01"].net_revenue / 3)
    assert m["2023-03-01"].net_revenue_pm == pytest.approx(m["2023-02-01"].net_revenue)


def test_validation_gate(micro):
    checks = run_checks(micro, months=24)
    assert checks.count() == 30 and not gate(checks)
    assert set(report(checks).columns) == {"status", "check", "detail"}


def test_datasets_on_stored_sales_are_those_of_the_tables(micro):
    """The checks read sales by product and order from one table: no further line meets an order, and no dataset changes."""
    m = with_stored_sales(micro)
    for name in analysis.CORE_DATASETS:
        assert sorted(map(str, dataset(m, name).collect())) == sorted(map(str, dataset(micro, name).collect())), name
    assert m.with_plans().given == m.given


def test_registry_rejects_unknown_names(micro):
    with pytest.raises(KeyError):
        dataset(micro, "vw_nothing")
    with pytest.raises(AttributeError):
        micro.no_such_table


def test_ad_hoc_select(micro):
    sql = "SELECT abc_class, count(*) AS n FROM vw_product_performance GROUP BY 1"
    assert sum(r.n for r in analysis.get_query(micro, sql).collect()) == 6


def test_row_rules_move_keys_only(spark, micro):
    """No amount or date leaves its row: the exchanges of the counts hold keys and numbers of rows."""
    counts = violation_counts(micro, ["sales_orders", "sales_order_items", "payments"])
    text = counts._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text
    assert {(r.table_name, r.rule) for r in counts.collect()} == {(t, rule) for t in ("sales_orders", "sales_order_items", "payments")
                                                                 for (rule,) in validate(micro, t)[1].selectExpr("explode(violations)").distinct().collect()}


def test_balances_of_large_positions_equal_those_of_small_ones(micro):
    """Positions of more than so many movements are followed month by month; which way a position goes changes no balance."""
    stored = stored_ledger(micro)
    calm, none = running_balances(stored)
    for most in (0, 1, 2):
        a, b = running_balances(stored, most)
        assert sorted(map(str, a.union(b).collect())) == sorted(map(str, calm.union(none).collect())) and (most or a.isEmpty())


def test_rules_that_are_not_asked_for_are_not_computed(spark, micro):
    rules = ["order has a line", "ledger = stock on hand", "sale movement refers to an order", "sold units = sale movements"]
    some = integrity_report(micro, rules)
    assert "Window" not in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in integrity_report(micro).collect() if r.rule in rules)
