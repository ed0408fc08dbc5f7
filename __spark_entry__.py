
from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle import ORACLE
from shelfmetrics.jobs import window_calendar
from shelfmetrics.plans import DATASETS, QUERIES, analysis, dataset
from shelfmetrics.plans.integrity import integrity_report, load_report
from shelfmetrics.plans.measures import TIME_MEASURES, all_data, by_year, measures
from shelfmetrics.plans.quality import null_profile
from shelfmetrics.plans.validation import report, run_checks
from shelfmetrics.sources import Retail, event_orders, testbed
from shelfmetrics.sources.validate import violation_counts

LLM_QUERIES, LLM_ORACLE = {}, {}
# The subpackage may be absent, and then its queries are too; a broken import inside it is an error.
if find_spec("corpus_pipeline") and getattr(find_spec("shelfmetrics.llm"), "origin", None):
    from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
    from corpus_pipeline import run as pipeline
    from shelfmetrics.llm.queries import QUERIES as LLM_QUERIES
    from shelfmetrics.llm.sql import ORACLE as LLM_ORACLE

    LLM_QUERIES = LLM_QUERIES | {"pipeline": pipeline}
    LLM_ORACLE = LLM_ORACLE | ({"pipeline": PIPELINE_SQL} if PIPELINE_SQL else {})

SMOKE_DIR = "/root/testdata/sf0.001"

# The reference's constants, moved into the data window of the driver's tables (1995 to 2001).
YEARS = (1998, 1999, 2000)
BEFORE, YEAR = YEARS[1:]
ARGUMENTS: dict[str, dict] = {
    "q50_category_growth": {"years": YEARS},
    "q51_declining_products": {"before": BEFORE, "year": YEAR},
    "q57_launch_groups": {"first_year": 1995},
    "q74_store_growth": {"before": BEFORE, "year": YEAR},
    "q79_order_value_gap": {"min_orders": 100},
    "q104_customer_sets": {"before": BEFORE, "year": YEAR},
    "q105_days_without_sales": {"store_code": "ST03", "first": "2000-12-01", "last": "2000-12-31"},
    "q109_category_region": {"regions": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"), "share_of": "ASIA"},
    "q203_bought_all": {"names": ("LARGE", "MEDIUM", "SMALL")},
    "q205_year_to_date": {"year": YEAR},
    "q402_products_to_review": {"before": BEFORE, "year": YEAR},
    "q403_operational_metrics": {"years": YEARS},
    "q501_customer_history": {"customer_id": 42},
    "q502_month_revenue": {"first": "2000-10-01", "until": "2000-11-01"},
    "q509_email_lookup": {"email": "USER123@example.com"},
    "q510_store_quarter": {"first": "2000-07-01", "until": "2000-10-01"},
    "q514_order_returns": {"order_id": 34},
    "q515_order_payments": {"order_id": 200},
}


def conform(df: DataFrame) -> DataFrame:
    """Result types both engines share: BIGINT for integers, DOUBLE for decimals and floats."""
    wide = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}

    def cast(name: str, kind: str):
        target = "double" if kind.startswith("decimal") else wide.get(kind)
        return F.col(f"`{name}`").cast(target).alias(name) if target else F.col(f"`{name}`")

    return df.select(*[cast(n, k) for n, k in df.dtypes])


_MODELS: dict[tuple[str, str], Retail] = {}


def _model(spark: SparkSession, sf_dir: str) -> Retail:
    """One model per session and folder: its tables are opened, and its plans built, once."""
    key = (f"{spark.sparkContext.applicationId}/{id(spark)}", sf_dir)
    if key not in _MODELS:
        _MODELS[key] = testbed(spark, sf_dir)
    return _MODELS[key]


def _named(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name][0]
    return lambda spark, sf_dir: conform(fn(_model(spark, sf_dir), **ARGUMENTS.get(name, {})))


def _time_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders carry no time of day in the driver's tables; purchase events do."""
    m = _model(spark, sf_dir).with_tables(sales_orders=event_orders(spark, sf_dir))
    return conform(QUERIES["q21_time_slots"][0](m))


def _scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(QUERIES["q301_scorecard"][0](_model(spark, sf_dir), run_day=F.lit("2001-08-01").cast("date")))


def _line_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returned line of order 34 with the largest refund stands for the wanted line; its key is a place in a file, hence looked up."""
    m = _model(spark, sf_dir)
    back = m.keyed("returns").filter(F.col("order_id") == 34).select("return_id").join(m.keyed("return_items"), "return_id")
    line = back.agg(F.max_by("order_item_id", "refund_amount")).scalar()
    return conform(QUERIES["q516_line_returns"][0](m, order_item_id=line).drop("return_item_id"))


# Line keys are places in files and exist only on the Spark side.
KEYS_LEFT_OUT = {
    "vw_sales_lines": ["order_item_id"], "vw_return_analysis": ["return_item_id", "return_id"],
    "q307_extreme_quantities": ["order_item_id"], "q514_order_returns": ["return_id"]}


def _without_keys(run: Callable, name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir).drop(*KEYS_LEFT_OUT[name])


def _dataset(name: str) -> Callable[[SparkSession, str], DataFrame]:
    options = {"year": YEAR, "before": BEFORE} if name == "vw_store_performance" else {}
    return lambda spark, sf_dir: conform(DATASETS[name][0](_model(spark, sf_dir), **options))


def _known_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole category lookup; the categories that stand for product types are those of the part table."""
    m = _model(spark, sf_dir)
    types = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("category_name")).distinct()
    of_types = m.categories.filter("category_id <= 6").join(types, "category_name", "left_semi")
    return conform(dataset(m.with_tables(categories=m.categories.filter("category_id > 6").unionByName(of_types)), "vw_category_canonical"))


# Analysis functions by the datasets they take.
ON_DATASETS: dict[str, tuple[Callable, list[str], dict]] = {
    "headline_kpis": (analysis.headline_kpis, ["vw_monthly_sales", "vw_customer_summary", "vw_inventory_health", "vw_orders"], {}),
    "growth_table": (analysis.growth_table, ["vw_monthly_sales"], {}),
    "yearly_summary": (analysis.yearly_summary, ["vw_monthly_sales"], {}),
    "seasonality_index": (analysis.seasonality_index, ["vw_monthly_sales"], {}),
    "channel_mix": (analysis.channel_mix, ["vw_monthly_sales"], {}),
    "revenue_trend_frame": (analysis.revenue_trend_frame, ["vw_monthly_sales"], {}),
    "category_table": (analysis.category_table, ["vw_category_performance"], {}),
    "category_trends": (analysis.category_trends, ["vw_category_performance"], {"years": YEARS}),
    "return_rate_frame": (analysis.return_rate_frame, ["vw_category_performance"], {}),
    "order_value_distribution": (analysis.order_value_distribution, ["vw_orders"], {}),
    "weekday_pattern": (analysis.weekday_pattern, ["vw_orders"], {}),
    "order_value_histogram": (analysis.order_value_histogram, ["vw_orders"], {}),
    "segment_summary": (analysis.segment_summary, ["vw_customer_summary"], {}),
    "rfm_summary": (analysis.rfm_summary, ["vw_customer_summary"], {}),
    "activity_status": (analysis.activity_status, ["vw_customer_summary"], {}),
    "repeat_rate": (analysis.repeat_rate, ["vw_customer_summary"], {}),
    "frequency_bands": (analysis.frequency_bands, ["vw_customer_summary"], {}),
    "customer_concentration": (analysis.customer_concentration, ["vw_customer_summary"], {}),
    "top_customers": (analysis.top_customers, ["vw_customer_summary"], {}),
    "customer_null_profile": (null_profile, ["vw_customer_summary"], {}),
    "health_summary": (analysis.health_summary, ["vw_inventory_health"], {}),
    "store_risk": (analysis.store_risk, ["vw_inventory_health"], {}),
    "replenishment_list": (analysis.replenishment_list, ["vw_inventory_health"], {}),
    "stock_aging": (analysis.aging, ["vw_inventory_health"], {}),
    "coverage_bands": (analysis.coverage_bands, ["vw_inventory_health"], {}),
    "turnover_by_category": (analysis.turnover_by_category, ["vw_product_performance"], {}),
    "product_classes": (analysis.product_classes, ["vw_product_performance"], {}),
    "top_products": (analysis.top_products, ["vw_product_performance"], {}),
    "top_products_frame": (analysis.top_products_frame, ["vw_product_performance"], {}),
    "abc_summary": (analysis.abc_summary, ["vw_product_performance"], {}),
    "product_concentration": (analysis.product_concentration, ["vw_product_performance"], {}),
    "high_return_products": (analysis.high_return_products, ["vw_product_performance"], {"times_category": 1.5}),
    "return_reasons": (analysis.return_reasons, ["vw_return_analysis"], {}),
    "store_revenue_frame": (analysis.store_revenue_frame, ["vw_store_performance"], {}),
}


def _on_datasets(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn, needs, options = ON_DATASETS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = _model(spark, sf_dir)
        return conform(fn(*[dataset(m, n) for n in needs], **options))
    return run


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# Rules whose rows exist in both engines without a line key.
COUNTED_RULES = [
    "line total = quantity x price - discount", "order has a line", "gst within total", "order after registration", "order after store opening",
    "employee works in the store", "online orders use the hub", "promotion on an eligible product", "promotion inside its window",
    "payments = order total", "cancelled orders are refunded", "completed orders are not refunded", "cash only in store",
    "returns on completed orders, after the order", "ledger = stock on hand", "ledger row has a position", "reserved <= on hand",
    "order header = sum of lines", "online orders have no employee", "price without tax above cost", "sale movement refers to an order",
    "cancelled orders move no stock", "calendar covers all order days", "line refers to a product", "order refers to a customer",
    "purchase total = sum of items", "received status has a received date", "ordered lines received nothing",
    "received units = purchase movements", "sold units = sale movements"]
TOTALS = [
    "net_revenue", "gross_profit", "cogs", "gross_margin_pct", "units_sold", "discount_given", "orders_line_basis", "completed_orders", "cancelled_orders",
    "cancellation_rate", "order_sales_incl_gst", "average_order_value", "total_customers", "purchase_frequency", "online_order_share", "buying_customers",
    "repeat_customers", "repeat_customer_rate", "avg_customer_lifetime_revenue", "active_customers_90d", "new_customers", "returning_customers",
    "orders_with_returns", "order_return_rate", "units_returned", "unit_return_rate", "refunded_net_of_gst", "refund_pct_of_net_revenue",
    "refunded_net_of_gst_by_return_date", "write_off_cost", "inventory_value", "units_on_hand", "stock_positions", "out_of_stock_positions",
    "low_stock_positions", "healthy_positions", "overstocked_positions", "dead_stock_positions", "overstock_value", "dead_stock_value",
    "surplus_share_of_value", "stock_out_risk_pct", "suggested_order_qty", "cogs_last_12m", "inventory_turnover", "days_of_inventory", "class_a_products",
    "class_a_revenue_share", "period_label"]
MONEY_TOTALS = ["net_revenue", "gross_profit", "cogs", "discount_given", "average_order_value", "avg_customer_lifetime_revenue", "refunded_net_of_gst",
                "refunded_net_of_gst_by_return_date", "write_off_cost", "days_of_inventory"]
RATIOS = ["gross_margin_pct", "cancellation_rate", "purchase_frequency", "online_order_share", "repeat_customer_rate", "order_return_rate",
          "unit_return_rate", "refund_pct_of_net_revenue", "surplus_share_of_value", "stock_out_risk_pct", "inventory_turnover", "class_a_revenue_share"]


def _measures(names: list[str], group_by: tuple[str, ...] = (), filters: dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = measures(_model(spark, sf_dir), names, group_by, filters)
        money = {c: 2 for c in df.columns if c in MONEY_TOTALS + ["inventory_value"] + TIME_MEASURES and not c.endswith("_pct")}
        parts = {c: 6 for c in df.columns if c in RATIOS or c.endswith("y_pct") or c.endswith("om_pct")}
        return conform(_rounded(df, money | parts))
    return run


def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(integrity_report(_model(spark, sf_dir), COUNTED_RULES))


ON_MODEL: dict[str, Callable[[Retail], DataFrame]] = {
    "cohort_retention": analysis.cohort_retention,
    "pareto_of_products": lambda m: analysis.pareto(
        m.inventory.join(m.products.select("product_id", "unit_cost"), "product_id").groupBy("product_id").agg(
            F.sum(F.col("quantity_on_hand") * F.col("unit_cost")).alias("value")), "product_id", "value", 70, 90),
    "product_change_frame": lambda m: analysis.product_change_frame(m, "LARGE", BEFORE, YEAR),
    "expected_kpis_all_data": all_data,
    "expected_kpis_by_year": by_year,
    "validation_report": lambda m: report(run_checks(m, months=80)),
    "validation_checks": lambda m: run_checks(m, months=80).select(F.col("check").alias("check_name"), "passed"),
    "integrity_report": integrity_report,
    "load_report": lambda m: load_report(m, years=(6, 7)),
    "calendar_window": window_calendar,
    "row_rule_violations": lambda m: violation_counts(m, [
        "stores", "suppliers", "products", "customers", "promotions", "sales_orders", "sales_order_items", "payments", "returns", "return_items",
        "inventory", "inventory_transactions", "purchases", "purchase_items"]),
}


def entry(spark: SparkSession) -> DataFrame:
    """The monthly sales dataset on the smallest tables."""
    return _dataset("vw_monthly_sales")(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _named(name) for name in QUERIES}
    out |= {"q21_time_slots": _time_slots, "q301_scorecard": _scorecard, "q516_line_returns": _line_returns}
    out |= {name: _dataset(name) for name in DATASETS}
    out["vw_category_canonical"] = _known_categories
    out |= {name: _on_datasets(name) for name in ON_DATASETS}
    out |= {name: (lambda spark, sf_dir, fn=fn: conform(fn(_model(spark, sf_dir)))) for name, fn in ON_MODEL.items()}
    out |= {
        "integrity_counts": _integrity,
        "measures_total": _measures(TOTALS),
        "measures_by_month": _measures(["net_revenue", *TIME_MEASURES, "new_customers", "returning_customers", "refunded_net_of_gst",
                                        "refunded_net_of_gst_by_return_date"], ("month",)),
        "measures_by_category": _measures(["net_revenue", "gross_margin_pct", "units_sold", "orders_line_basis", "completed_orders", "units_returned",
                                           "unit_return_rate", "inventory_value", "inventory_turnover", "class_a_products"], ("category",)),
        "measures_sliced": _measures(["net_revenue", "completed_orders", "average_order_value", "order_return_rate", "unit_return_rate", "stock_positions"],
                                     ("region", "channel"), {"year": [BEFORE, YEAR]}),
    }
    for name in KEYS_LEFT_OUT:
        out[name] = _without_keys(out[name], name)
    return out | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE | LLM_ORACLE
