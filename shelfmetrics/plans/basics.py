"""Basic counts and totals (Q01-Q12)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_double, band, day_of, net_of_tax, part_of_total, pct, ratio, rnd, stacked
from ..operators import percentiles
from ..sources import Retail
from .datasets import NO_CATEGORY, asof_day, completed, sold_lines
from .registry import query

COUNTED_TABLES = ["customers", "products", "sales_orders", "sales_order_items", "payments", "returns", "inventory",
                  "inventory_transactions", "purchases"]
PRICE_BANDS = [(500, "a) Under 500"), (2000, "b) 500 - 1,999"), (10000, "c) 2,000 - 9,999")]
TOP_PRICE_BAND = "d) 10,000 and above"


@query("Row count of the main tables")
def q01_table_sizes(m: Retail) -> DataFrame:
    return stacked(*[getattr(m, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("row_count")) for t in COUNTED_TABLES]
                   ).orderBy(F.col("row_count").desc(), "table_name")


@query("Order totals and cancellation rate in one scan")
def q02_order_totals(m: Retail) -> DataFrame:
    gone = F.col("order_status") == "CANCELLED"
    return m.sales_orders.agg(
        F.count("*").alias("total_orders"), F.count_if(F.col("order_status") == "COMPLETED").alias("completed_orders"),
        F.count_if(gone).alias("cancelled_orders"), pct(F.count_if(gone), F.count("*"), 2).alias("cancellation_rate_pct"))


@query("Gross sales, GST, net revenue and discounts of completed orders")
def q03_sales_totals(m: Retail) -> DataFrame:
    return completed(m).agg(
        F.sum("total_amount").alias("gross_sales_incl_gst"), F.sum("gst_amount").alias("gst_collected"),
        F.sum("net_amount").alias("net_revenue"), F.sum("discount_amount").alias("discounts_given"))


@query("Net revenue, cost of goods sold, gross profit and margin")
def q04_gross_profit(m: Retail) -> DataFrame:
    return sold_lines(m).agg(
        rnd(F.sum("net_revenue")).alias("net_revenue"), rnd(F.sum("cogs")).alias("cost_of_goods_sold"),
        rnd(F.sum("gross_profit")).alias("gross_profit"),
        pct(F.sum("gross_profit"), F.sum("net_revenue"), 2).alias("gross_margin_pct"))


@query("Mean, median and largest order value")
def q05_order_value(m: Retail) -> DataFrame:
    orders = completed(m)
    middle = percentiles(orders.select("total_amount"), "total_amount", {"p50": 0.5})
    return orders.agg(rnd(ratio(F.sum("total_amount"), F.count("*"))).alias("avg_order_value"),
                      rnd(middle.select("p50").scalar()).alias("median_order_value"),
                      F.max("total_amount").alias("largest_order"))


@query("Customers: total, buyers, never purchased, flagged active")
def q06_customer_counts(m: Retail) -> DataFrame:
    bought = completed(m).select("customer_id").distinct().withColumn("bought", F.lit(True))
    return m.customers.select("customer_id", "is_active").join(bought, "customer_id", "left").agg(
        F.count("*").alias("total_customers"), F.count("bought").alias("customers_who_purchased"),
        F.count_if(F.col("bought").isNull()).alias("customers_never_purchased"), F.count_if("is_active").alias("flagged_active"))


@query("Orders and revenue share by channel")
def q07_channels(m: Retail) -> DataFrame:
    by = completed(m).groupBy("channel").agg(F.count("*").alias("orders"), F.sum("net_amount").alias("net_revenue"))
    return part_of_total(by, "net_revenue", "revenue_share_pct").orderBy(F.col("net_revenue").desc())


@query("Products per category, products without one included")
def q08_products_per_category(m: Retail) -> DataFrame:
    names = m.categories.select("category_id", "category_name")
    by = m.products.groupBy("category_id").agg(F.count("*").alias("n"), F.count_if("is_active").alias("a"))
    return (by.join(names, "category_id", "left").groupBy(F.coalesce("category_name", F.lit(NO_CATEGORY)).alias("category"))
            .agg(F.sum("n").alias("products"), F.sum("a").alias("active_products")).filter(F.col("products") >= 1)
            .orderBy(F.col("products").desc(), "category"))


@query("Store directory with years open at the as-of day")
def q09_store_directory(m: Retail) -> DataFrame:
    years = rnd(as_double(F.datediff(asof_day(m), F.col("opened_date"))) / 365.25, 1)
    return m.stores.select("store_code", "store_name", "city", "state", "region", "store_type", "opened_date",
                           years.alias("years_open")).orderBy("region", "opened_date")


@query("Catalogue price bands with average list margin")
def q10_price_bands(m: Retail) -> DataFrame:
    net = net_of_tax("unit_price", "gst_rate")
    margin = F.lit(100.0) * (net - as_double("unit_cost")) / net
    return m.products.groupBy(band("unit_price", PRICE_BANDS, TOP_PRICE_BAND).alias("price_band")).agg(
        F.count("*").alias("products"), rnd(F.avg(margin), 1).alias("avg_list_margin_pct")).orderBy("price_band")


@query("Orders and average value by ISO weekday")
def q11_weekdays(m: Retail) -> DataFrame:
    return (completed(m).groupBy((F.weekday("order_day") + 1).alias("iso_day"), F.date_format("order_day", "EEEE").alias("day_name"))
            .agg(F.count("*").alias("orders"), rnd(ratio(F.sum("total_amount"), F.count("*"))).alias("avg_order_value"))
            .orderBy("iso_day"))


@query("Data window: first and last order, days, calendar span")
def q12_data_window(m: Retail) -> DataFrame:
    w = m.sales_orders.agg(F.min("order_date").alias("a"), F.max("order_date").alias("z"))
    first, last = day_of("a"), day_of("z")
    months = F.floor(F.months_between(last, first)).cast("int")
    rest = F.datediff(last, F.add_months(first, months))
    return w.select(
        first.alias("first_order"), last.alias("last_order"), F.datediff(last, first).alias("days_covered"),
        F.concat_ws(" ", F.concat(F.floor(months / 12), F.lit(" years")), F.concat(months % 12, F.lit(" mons")),
                    F.concat(rest, F.lit(" days"))).alias("span"))
