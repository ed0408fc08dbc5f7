"""Analysis functions over the canonical datasets: datasets in, one small frame out. Nothing is collected."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import as_double, band, growth_pct, inline_rows, one_row, part_of_total, pct, ratio, rnd, top
from ..operators import abc_classes, percentiles, previous, quantile_buckets, running, trailing_mean
from ..sources import Retail
from .customers import cohort_activity, last_full_cohort
from .datasets import (ACTIVITY_LABELS, HEALTH_STATUSES, NO_CATEGORY, RFM_LABELS, canonical_products, completed, dataset, sold_lines)
from .inventory import SHORT, SURPLUS
from .products import concentration_row, trend_flag, yearly_revenue

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CORE_DATASETS = ["vw_monthly_sales", "vw_product_performance", "vw_customer_summary", "vw_inventory_health", "vw_store_performance",
                 "vw_category_performance", "vw_supplier_performance", "vw_return_analysis"]


def extract_core(m: Retail) -> dict[str, DataFrame]:
    """The eight small datasets by name, lazily."""
    return {name: dataset(m, name) for name in CORE_DATASETS}


def get_query(m: Retail, sql: str) -> DataFrame:
    """Ad-hoc SELECT over the model's tables and datasets, as temp views."""
    m.register_views()
    for name in CORE_DATASETS + ["vw_asof", "vw_category_canonical", "vw_sales_lines", "vw_orders"]:
        if name in sql:
            dataset(m, name).createOrReplaceTempView(name)
    return m.spark.sql(sql)


def labelled(spark, names: list[str], column: str) -> DataFrame:
    """Fixed rows of a presentation order, with their place."""
    return inline_rows(spark, list(enumerate(names)), f"_place int, {column} string")


# ---- KPIs ------------------------------------------------------------------------------------------------------------

def headline_kpis(monthly: DataFrame, customers: DataFrame, inventory: DataFrame, orders: DataFrame) -> DataFrame:
    done = F.col("order_status") == "COMPLETED"
    bought = F.col("orders") > 0
    row = one_row(
        monthly.agg(F.sum("orders").alias("done"), F.sum("net_revenue").alias("net"), F.sum("gross_profit").alias("profit"),
                    F.sum("gross_sales_incl_gst").alias("gross")),
        top(monthly, 12, F.col("month").desc()).agg(F.sum("cogs").alias("cogs")),
        customers.agg(F.count_if(bought).alias("buyers"), F.count_if(F.col("orders") >= 2).alias("repeat"),
                      F.avg(F.when(bought, F.col("net_revenue"))).alias("lifetime")),
        inventory.agg(F.sum("inventory_value").alias("stock")),
        orders.agg(F.count_if(F.col("order_status") == "CANCELLED").alias("gone"), F.count_if(done).alias("n"),
                   F.count_if(done & F.col("has_return")).alias("back")))
    return row.select(
        rnd("net", 0).alias("net_revenue"), rnd("profit", 0).alias("gross_profit"), pct("profit", "net", 2).alias("gross_margin_pct"),
        F.col("done").alias("completed_orders"), F.col("gone").alias("cancelled_orders"), F.col("buyers").alias("buying_customers"),
        rnd(ratio("gross", "done"), 0).alias("avg_order_value"), pct("repeat", "buyers", 1).alias("repeat_customer_rate_pct"),
        pct("back", "n", 2).alias("order_return_rate_pct"), rnd("stock", 0).alias("inventory_value_at_cost"),
        rnd(ratio("cogs", "stock")).alias("inventory_turnover_12m"), rnd("lifetime", 0).alias("avg_customer_lifetime_revenue"))


def growth_table(monthly: DataFrame) -> DataFrame:
    net = as_double("net_revenue")
    m = monthly.select("month", net.alias("net_revenue"), "orders", "gross_profit")
    return m.select(
        "*", growth_pct("net_revenue", previous("net_revenue", "month"), 4).alias("mom_growth_pct"),
        growth_pct("net_revenue", previous("net_revenue", "month", 12), 4).alias("yoy_growth_pct"),
        rnd(trailing_mean("net_revenue", "month", 3)).alias("moving_avg_3m"), rnd(running("net_revenue", "month")).alias("running_total"))


def yearly_summary(monthly: DataFrame) -> DataFrame:
    y = monthly.groupBy("year").agg(F.sum("orders").alias("orders"), rnd(F.sum("net_revenue")).alias("net_revenue"),
                                    rnd(F.sum("gross_profit")).alias("gross_profit"))
    return y.select("*", pct("gross_profit", "net_revenue", 4).alias("margin_pct"),
                    growth_pct("net_revenue", previous("net_revenue", "year"), 4).alias("yoy_growth_pct"))


def pareto(df: DataFrame, key: str, value: str, a_cut: float = 80.0, b_cut: float = 95.0) -> DataFrame:
    """ABC classes of any positive measure; the cut-offs are arguments."""
    return abc_classes(df.filter(F.col(value) > 0).select(key, value), value, key, a_cut, b_cut).select(
        key, F.col(value).alias("value"), rnd("share_pct", 4).alias("share_pct"), rnd("cumulative_pct", 4).alias("cumulative_pct"), "abc_class")


# ---- sales -----------------------------------------------------------------------------------------------------------

def seasonality_index(monthly: DataFrame) -> DataFrame:
    against = ratio("net_revenue", F.avg("net_revenue").over(Window.partitionBy("year")))
    names = F.array(*[F.lit(n) for n in MONTHS])
    return monthly.select("month_number", against.alias("v")).groupBy("month_number").agg(F.avg("v").alias("v")).select(
        "month_number", F.get(names, F.col("month_number") - 1).alias("month"), rnd(F.lit(100.0) * F.col("v"), 1).alias("seasonality_index"))


def channel_mix(monthly: DataFrame) -> DataFrame:
    y = monthly.groupBy("year").agg(F.sum("orders").alias("orders"), F.sum("online_orders").alias("online_orders"))
    return y.withColumn("online_share_pct", pct("online_orders", "orders", 4))


def category_table(categories: DataFrame) -> DataFrame:
    latest = categories.agg(F.max("year")).scalar()
    return categories.filter(F.col("year") == latest).orderBy(F.col("net_revenue").desc()).select(
        "category_name", "net_revenue", "share_of_year_revenue_pct", "margin_pct", "yoy_growth_pct")


def order_value_distribution(orders: DataFrame) -> DataFrame:
    v = orders.filter(F.col("order_status") == "COMPLETED").select(as_double("total_amount").alias("v"))
    q = percentiles(v, "v", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99})
    row = one_row(v.agg(F.avg("v").alias("mean"), F.max("v").alias("max")), q)
    return row.select(rnd("mean").alias("mean"), *[rnd(c, 3).alias(c) for c in ("median", "p25", "p75", "p90", "p99")], "max",
                      rnd(F.col("p75") + 1.5 * (F.col("p75") - F.col("p25")), 3).alias("iqr_fence"))


def weekday_pattern(orders: DataFrame) -> DataFrame:
    by = orders.filter(F.col("order_status") == "COMPLETED").groupBy(F.date_format("order_date", "EEEE").alias("weekday")).agg(
        F.count("*").alias("orders"), rnd(ratio(F.sum("total_amount"), F.count("*"))).alias("avg_order_value"))
    return labelled(orders.sparkSession, WEEKDAYS, "weekday").join(by, "weekday", "left").orderBy("_place").drop("_place")


# ---- customers -------------------------------------------------------------------------------------------------------

def only_buyers(customers: DataFrame) -> DataFrame:
    return customers.filter(F.col("orders") > 0)


def segment_summary(customers: DataFrame) -> DataFrame:
    by = only_buyers(customers).groupBy("segment").agg(
        F.count("*").alias("customers"), F.sum("orders").alias("orders"), F.sum("net_revenue").alias("net_revenue"),
        rnd(ratio(F.sum("net_revenue"), F.count("*"))).alias("avg_lifetime_revenue"), rnd(F.avg("gross_profit")).alias("avg_lifetime_profit"))
    return part_of_total(by, "net_revenue", "revenue_share_pct", 4).orderBy(F.col("net_revenue").desc())


def rfm_summary(customers: DataFrame) -> DataFrame:
    by = only_buyers(customers).groupBy("rfm_segment").agg(
        F.count("*").alias("customers"), F.sum("net_revenue").alias("net_revenue"), rnd(F.avg("recency_days"), 4).alias("avg_recency_days"),
        rnd(F.avg("orders"), 4).alias("avg_orders"))
    shared = part_of_total(part_of_total(by, "customers", "customer_share_pct", 4), "net_revenue", "revenue_share_pct", 4)
    return labelled(customers.sparkSession, RFM_LABELS, "rfm_segment").join(shared, "rfm_segment", "left").orderBy("_place").drop("_place")


def activity_status(customers: DataFrame) -> DataFrame:
    by = part_of_total(customers.groupBy("activity_status").agg(F.count("*").alias("customers")), "customers", "share_pct", 4)
    return labelled(customers.sparkSession, ACTIVITY_LABELS, "activity_status").join(by, "activity_status", "left").orderBy("_place").drop("_place")


def repeat_rate(customers: DataFrame) -> DataFrame:
    twice = F.count_if(F.col("orders") >= 2)
    return only_buyers(customers).agg(F.count("*").alias("buying_customers"), twice.alias("repeat_customers"),
                                      pct(twice, F.count("*"), 4).alias("repeat_customer_rate_pct"))


def frequency_bands(customers: DataFrame) -> DataFrame:
    label = band("orders", [(1, "1 order"), (3, "2-3 orders"), (6, "4-6 orders"), (12, "7-12 orders")], "13+ orders", closed=True)
    by = only_buyers(customers).groupBy(label.alias("frequency_band")).agg(F.count("*").alias("customers"), F.sum("net_revenue").alias("net_revenue"))
    return part_of_total(part_of_total(by, "customers", "customer_share_pct", 4), "net_revenue", "revenue_share_pct", 4)


def customer_concentration(customers: DataFrame) -> DataFrame:
    """Deciles by rank, ties broken by the key; decile 10 holds the best buyers."""
    ranked = quantile_buckets(only_buyers(customers).select("customer_id", "net_revenue"), 10,
                              [F.col("net_revenue").asc(), F.col("customer_id").asc()], "decile")
    by = ranked.groupBy("decile").agg(F.sum("net_revenue").alias("net_revenue"))
    return part_of_total(by, "net_revenue", "revenue_share_pct", 4).orderBy(F.col("decile").desc())


def cohort_retention(m: Retail, max_month: int = 6) -> DataFrame:
    """Share of each cohort that buys k months later, for cohorts with the full follow-up."""
    known = cohort_activity(m).filter(F.col("cohort") <= last_full_cohort(m, max_month))
    size = F.sum(F.when(F.col("k") == 0, F.col("customers")))
    return known.groupBy("cohort").agg(size.alias("cohort_size"), *[
        pct(F.sum(F.when(F.col("k") == k, F.col("customers"))), size, 4).alias(f"m{k}") for k in range(max_month + 1)]).orderBy("cohort")


def top_customers(customers: DataFrame, n: int = 10) -> DataFrame:
    return top(customers, n, F.col("net_revenue").desc(), F.col("customer_id")).select(
        "customer_id", "customer_name", "segment", "orders", "net_revenue", "avg_order_value", "last_order_date", "rfm_segment")


# ---- inventory -------------------------------------------------------------------------------------------------------

def health_summary(inventory: DataFrame) -> DataFrame:
    by = inventory.groupBy("health_status").agg(F.count("*").alias("positions"), F.sum("quantity_on_hand").alias("units"),
                                                F.sum("inventory_value").alias("value_at_cost"))
    shared = part_of_total(part_of_total(by, "positions", "position_share_pct", 4), "value_at_cost", "value_share_pct", 4)
    return labelled(inventory.sparkSession, HEALTH_STATUSES, "health_status").join(shared, "health_status", "left").orderBy("_place").drop("_place")


def store_risk(inventory: DataFrame) -> DataFrame:
    surplus = F.sum(F.when(F.col("health_status").isin(SURPLUS), F.col("inventory_value")).otherwise(0))
    by = inventory.groupBy("store_name").agg(
        F.count("*").alias("positions"), F.count_if(F.col("health_status").isin(SHORT)).alias("at_risk_positions"),
        F.sum("inventory_value").alias("inventory_value"), surplus.alias("surplus_value"))
    return by.select("*", pct("at_risk_positions", "positions", 4).alias("stock_out_risk_pct"),
                     pct("surplus_value", "inventory_value", 4).alias("surplus_share_pct")).orderBy(F.col("surplus_value").desc())


def replenishment_list(inventory: DataFrame, n: int = 25) -> DataFrame:
    need = inventory.filter((F.col("quantity_on_hand") <= F.col("reorder_level")) & (F.col("units_sold_90d") > 0))
    return top(need, n, F.col("avg_daily_demand").desc(), F.col("store_id"), F.col("product_id")).select(
        "store_name", "product_name", "quantity_on_hand", "reorder_level", "avg_daily_demand", "inbound_quantity", "suggested_order_qty")


def aging(inventory: DataFrame) -> DataFrame:
    """Positions without a restock day belong to no band."""
    days = F.col("days_since_restock")
    label = band(days, [(30, "0-30 days"), (90, "31-90 days"), (180, "91-180 days"), (365, "181-365 days")], "over 365 days", closed=True)
    by = inventory.filter((F.col("quantity_on_hand") > 0) & days.isNotNull()).groupBy(label.alias("stock_age")).agg(
        F.count("*").alias("positions"), F.sum("inventory_value").alias("value_at_cost"))
    return part_of_total(by, "value_at_cost", "value_share_pct", 4)


def coverage_bands(inventory: DataFrame) -> DataFrame:
    """Right-closed bands on the rounded cover."""
    label = band("days_of_cover", [(7, "under 7 days"), (30, "7-29 days"), (90, "30-89 days"), (180, "90-179 days")], "180+ days", closed=True)
    by = inventory.filter(F.col("days_of_cover").isNotNull()).groupBy(label.alias("cover")).agg(
        F.count("*").alias("positions"), F.sum("inventory_value").alias("value_at_cost"))
    return part_of_total(by, "positions", "position_share_pct", 4)


def turnover_by_category(products: DataFrame) -> DataFrame:
    """Cost of twelve months is turnover times value, as stored."""
    cost = F.sum(F.coalesce("inventory_turnover_12m", F.lit(0.0)) * as_double("inventory_value"))
    by = products.groupBy("category").agg(rnd(cost).alias("cogs_12m"), F.sum("inventory_value").alias("inventory_value"))
    turn = ratio("cogs_12m", "inventory_value")
    return by.select("category", "cogs_12m", "inventory_value", rnd(turn, 4).alias("inventory_turnover"), rnd(F.lit(365.0) / F.nullif(turn, F.lit(0.0)), 1).alias("days_of_inventory"))


def product_classes(products: DataFrame) -> DataFrame:
    return products.filter(F.col("product_class").isNotNull()).groupBy("product_class").agg(
        F.count("*").alias("products"), F.sum("inventory_value").alias("inventory_value"))


# ---- products and returns --------------------------------------------------------------------------------------------

def top_products(products: DataFrame, n: int = 10, by: str = "net_revenue") -> DataFrame:
    return top(products, n, F.col(by).desc(), F.col("product_id")).select(
        "product_name", "category", "units_sold", "net_revenue", "gross_profit", "margin_pct", "return_rate_pct", "abc_class")


def abc_summary(products: DataFrame) -> DataFrame:
    by = products.filter(F.col("units_sold") > 0).groupBy("abc_class").agg(F.count("*").alias("products"), rnd(F.sum("net_revenue")).alias("net_revenue"))
    shared = part_of_total(part_of_total(by, "products", "product_share_pct", 4), "net_revenue", "revenue_share_pct", 4)
    return shared.filter(F.col("abc_class").isin("A", "B", "C")).orderBy("abc_class")


def product_concentration(products: DataFrame) -> DataFrame:
    sold = products.filter(F.col("net_revenue") > 0).select("product_id", as_double("net_revenue").alias("net"))
    return concentration_row(abc_classes(sold, "net", "product_id"), "net")


def category_trends(categories: DataFrame, years: tuple[int, int, int] = (2023, 2024, 2025)) -> DataFrame:
    a, b, c = (str(y) for y in years)
    p = categories.groupBy("category_name").pivot("year", list(years)).agg(F.sum("net_revenue"))
    return p.select(
        "category_name", *[rnd(y).alias(f"rev_{y}") for y in (a, b, c)], growth_pct(b, a, 4).alias(f"growth_{b}_pct"),
        growth_pct(c, b, 4).alias(f"growth_{c}_pct"), trend_flag(years, a, b, c).alias("trend")).orderBy(f"growth_{c}_pct")


def high_return_products(products: DataFrame, min_units: int = 40, min_returned: int = 8, times_category: float = 2.5) -> DataFrame:
    sold = products.filter(F.col("units_sold") > 0)
    cats = sold.groupBy("category").agg(pct(F.sum("units_returned"), F.sum("units_sold")).alias("category_rate_pct"))
    rated = sold.join(cats, "category").withColumn("times_category_rate", ratio("return_rate_pct", "category_rate_pct"))
    return rated.filter((F.col("units_sold") >= min_units) & (F.col("units_returned") >= min_returned)
                        & (F.col("times_category_rate") >= times_category)).orderBy(F.col("times_category_rate").desc()).select(
        "product_name", "category", "units_sold", "units_returned", "return_rate_pct", rnd("category_rate_pct", 4).alias("category_rate_pct"),
        rnd("times_category_rate", 4).alias("times_category_rate"))


def return_reasons(returns: DataFrame) -> DataFrame:
    by = returns.groupBy("return_reason").agg(F.count("*").alias("return_lines"), F.sum("units_returned").alias("units"),
                                              rnd(F.sum("refund_net_of_gst")).alias("refund_net"))
    return part_of_total(by, "return_lines", "share_pct", 4).orderBy(F.col("return_lines").desc())


# ---- frames behind the charts ----------------------------------------------------------------------------------------

def revenue_trend_frame(monthly: DataFrame) -> DataFrame:
    """Month, revenue, three-month mean and a flag on the peak month."""
    peak = monthly.agg(F.max_by("month", "net_revenue")).scalar()
    return monthly.select("month", "net_revenue", rnd(trailing_mean("net_revenue", "month", 3)).alias("moving_avg_3m"),
                          (F.col("month") == peak).alias("is_peak")).orderBy("month")


def top_products_frame(products: DataFrame, n: int = 10) -> DataFrame:
    whole = products.agg(F.sum("net_revenue")).scalar()
    return top(products, n, F.col("net_revenue").desc(), F.col("product_id")).select(
        "product_name", "net_revenue", pct("net_revenue", whole, 4).alias("revenue_share_pct"))


def store_revenue_frame(stores: DataFrame) -> DataFrame:
    return stores.select("store_name", "net_revenue").orderBy(F.col("net_revenue").desc())


def return_rate_frame(categories: DataFrame) -> DataFrame:
    """Unit return rate by category, and over all as a row of its own."""
    def rate(df: DataFrame) -> DataFrame:
        return df.withColumn("unit_return_rate_pct", pct("units_returned", "units_sold", 4))
    sums = [F.sum("units_sold").alias("units_sold"), F.sum("units_returned").alias("units_returned")]
    return rate(categories.groupBy("category_name").agg(*sums)).unionByName(
        rate(categories.agg(F.lit("(overall)").alias("category_name"), *sums)))


def order_value_histogram(orders: DataFrame, bins: int = 60) -> DataFrame:
    """Orders by bins of equal width in log10 of the value, with the bin's bounds."""
    logs = orders.filter((F.col("order_status") == "COMPLETED") & (F.col("total_amount") > 0)).select(F.log10(as_double("total_amount")).alias("x"))
    low, high = logs.agg(F.min("x")).scalar(), logs.agg(F.max("x")).scalar()
    placed = logs.select(F.least(F.floor((F.col("x") - low) / (high - low) * bins) + 1, F.lit(bins)).alias("bin"), "x")
    return placed.groupBy("bin").agg(F.count("*").alias("orders"), rnd(F.pow(F.lit(10.0), F.min("x"))).alias("smallest"),
                                     rnd(F.pow(F.lit(10.0), F.max("x"))).alias("largest")).orderBy("bin")


def product_change_frame(m: Retail, category: str, before: int = 2024, year: int = 2025, n: int = 10) -> DataFrame:
    """Products of one category with the largest fall in revenue from one year to the next."""
    inside = canonical_products(m).filter(F.coalesce("canonical_name", F.lit(NO_CATEGORY)) == category).select("product_id", "product_name")
    years = yearly_revenue(sold_lines(m), (before, year), "product_id").join(inside, "product_id")
    old, new = F.coalesce(f"rev_{before}", F.lit(0.0)), F.coalesce(f"rev_{year}", F.lit(0.0))
    change = years.select("product_id", "product_name", rnd(old).alias(f"rev_{before}"), rnd(new).alias(f"rev_{year}"), rnd(new - old).alias("change"))
    return top(change, n, F.col("change"), F.col("product_id"))


def base_revenue(m: Retail) -> DataFrame:
    return completed(m).agg(F.sum("net_amount").alias("revenue"), F.count("*").alias("orders"))


def shares_by(column: Column, df: DataFrame) -> DataFrame:
    """Row counts by any column with their percent share, for the band charts."""
    return part_of_total(df.groupBy(column).agg(F.count("*").alias("rows")), "rows", "share_pct", 2)
