"""Sales trends, growth, mix and promotions (Q13-Q31)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import (band, basket_label, day_of, growth_pct, part_of_total, pct, quarter_of, ratio, rnd, top)
from ..operators import previous, running, trailing_mean
from ..sources import Retail, shared
from .datasets import NO_CATEGORY, asof_day, canonical_products, completed, first_day, sold_lines
from .registry import query


@shared
def monthly_revenue(m: Retail) -> DataFrame:
    return completed(m).groupBy(F.col("order_month").alias("month")).agg(F.sum("net_amount").alias("net"))


@query("Monthly revenue trend")
def q13_monthly_trend(m: Retail) -> DataFrame:
    return (completed(m).groupBy(F.col("order_month").alias("month"))
            .agg(F.count("*").alias("orders"), F.sum("net_amount").alias("net_revenue"),
                 rnd(ratio(F.sum("total_amount"), F.count("*"))).alias("avg_order_value")).orderBy("month"))


@query("Yearly revenue and growth")
def q14_yearly_growth(m: Retail) -> DataFrame:
    y = completed(m).groupBy(F.col("order_year").alias("yr")).agg(F.count("*").alias("orders"), F.sum("net_amount").alias("net"))
    before = previous("net", "yr")
    return y.select("yr", "orders", rnd("net", 0).alias("net_revenue"), rnd(before, 0).alias("previous_year_revenue"),
                    growth_pct("net", before, 2).alias("yoy_growth_pct")).orderBy("yr")


@query("Month-over-month growth")
def q15_month_growth(m: Retail) -> DataFrame:
    return monthly_revenue(m).select("month", rnd("net", 0).alias("revenue"),
                                     growth_pct("net", previous("net", "month"), 2).alias("mom_growth_pct")).orderBy("month")


@shared
def product_totals(m: Retail) -> DataFrame:
    """Per sold product, before the product's own attributes are joined."""
    return sold_lines(m).groupBy("product_id").agg(
        F.sum("quantity").alias("units"), F.sum("net_revenue").alias("net"), F.sum("gross_profit").alias("profit"))


@query("Top ten products by revenue")
def q16_top_products_by_revenue(m: Retail, n: int = 10) -> DataFrame:
    best = top(product_totals(m), n, F.col("net").desc(), F.col("product_id"))
    return (best.join(m.products.select("product_id", "product_name"), "product_id")
            .select("product_id", "product_name", F.col("units").alias("units_sold"), rnd("net", 0).alias("net_revenue"))
            .orderBy(F.col("net_revenue").desc(), "product_id"))


@query("Top ten products by units, revenue per unit")
def q17_top_products_by_units(m: Retail, n: int = 10) -> DataFrame:
    best = top(product_totals(m), n, F.col("units").desc(), F.col("product_id"))
    return (best.join(m.products.select("product_id", "product_name"), "product_id")
            .select("product_id", "product_name", F.col("units").alias("units_sold"),
                    rnd(ratio("net", "units")).alias("net_revenue_per_unit")).orderBy(F.col("units_sold").desc(), "product_id"))


@query("Category revenue, share and cumulative share, case variants merged")
def q18_category_contribution(m: Retail) -> DataFrame:
    names = canonical_products(m).select("product_id", F.coalesce("canonical_name", F.lit(NO_CATEGORY)).alias("category"))
    by = product_totals(m).join(names, "product_id").groupBy("category").agg(F.sum("units").alias("units_sold"), F.sum("net").alias("net"))
    upto = F.sum("net").over(Window.orderBy(F.col("net").desc()))
    return part_of_total(by, "net", "revenue_share_pct").select(
        "category", "units_sold", rnd("net", 0).alias("net_revenue"), "revenue_share_pct",
        pct(upto, F.sum("net").over(Window.partitionBy()), 2).alias("cumulative_share_pct")).orderBy(F.col("net_revenue").desc())


@shared
def revenue_by_store(m: Retail) -> DataFrame:
    return completed(m).groupBy("store_id").agg(F.count("*").alias("orders"), F.sum("net_amount").alias("net"),
                                                F.sum("total_amount").alias("gross"))


@query("Revenue by store city, region and type, ranked")
def q19_city_ranking(m: Retail) -> DataFrame:
    by = (revenue_by_store(m).join(m.stores, "store_id").groupBy("city", "region", "store_type")
          .agg(F.sum("orders").alias("orders"), F.sum("net").alias("net")))
    return by.select("city", "region", "store_type", "orders", rnd("net", 0).alias("net_revenue"),
                     F.rank().over(Window.orderBy(F.col("net").desc())).alias("revenue_rank")).orderBy("revenue_rank")


@query("Top ten customer cities by revenue")
def q20_customer_cities(m: Retail, n: int = 10) -> DataFrame:
    per = completed(m).groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("net_amount").alias("net"))
    by = (per.join(m.customers.select("customer_id", "city"), "customer_id")
          .groupBy(F.coalesce("city", F.lit("(unknown)")).alias("customer_city"))
          .agg(F.count("*").alias("buying_customers"), F.sum("n").alias("orders"), F.sum("net").alias("net")))
    return top(by, n, F.col("net").desc(), F.col("customer_city")).select(
        "customer_city", "buying_customers", "orders", rnd("net", 0).alias("net_revenue"))


@query("Sales by time of day")
def q21_time_slots(m: Retail) -> DataFrame:
    slot = band(F.hour("order_date"), [(12, "1) Morning (10-12)"), (16, "2) Afternoon (12-16)"), (19, "3) Evening (16-19)")],
                "4) Night (19-22)")
    return completed(m).groupBy(slot.alias("time_slot")).agg(
        F.count("*").alias("orders"), rnd(F.sum("net_amount"), 0).alias("net_revenue")).orderBy("time_slot")


@query("Running revenue total by month")
def q22_running_total(m: Retail) -> DataFrame:
    return monthly_revenue(m).select("month", rnd("net", 0).alias("revenue"),
                                     rnd(running("net", "month"), 0).alias("running_total")).orderBy("month")


@query("Three-month moving average, empty until the window is full")
def q23_moving_average(m: Retail, months: int = 3) -> DataFrame:
    return monthly_revenue(m).select("month", rnd("net", 0).alias("revenue"),
                                     rnd(trailing_mean("net", "month", months), 0).alias("moving_avg_3m")).orderBy("month")


@query("Top three months of each year")
def q24_best_months(m: Retail, n: int = 3) -> DataFrame:
    ranked = monthly_revenue(m).withColumn("yr", F.year("month")).withColumn(
        "rank_in_year", F.rank().over(Window.partitionBy("yr").orderBy(F.col("net").desc())))
    return (ranked.filter(F.col("rank_in_year") <= n).select("yr", "month", rnd("net", 0).alias("revenue"), "rank_in_year")
            .orderBy("yr", "rank_in_year"))


@query("Channel revenue pivot by year")
def q25_channel_pivot(m: Retail) -> DataFrame:
    p = completed(m).groupBy(F.col("order_year").alias("yr")).pivot("channel", ["IN_STORE", "ONLINE"]).agg(F.sum("net_amount"))
    whole = F.coalesce("IN_STORE", F.lit(0)) + F.coalesce("ONLINE", F.lit(0))
    return p.select("yr", rnd("IN_STORE", 0).alias("in_store_revenue"), rnd("ONLINE", 0).alias("online_revenue"),
                    pct("ONLINE", whole, 2).alias("online_share_pct")).orderBy("yr")


@query("Quarterly revenue with growth over the same quarter of last year")
def q26_quarterly_growth(m: Retail) -> DataFrame:
    q = completed(m).groupBy(quarter_of("order_day").alias("start")).agg(F.sum("net_amount").alias("net"))
    return q.select(F.concat(F.year("start"), F.lit("-Q"), F.quarter("start")).alias("quarter"), rnd("net", 0).alias("revenue"),
                    growth_pct("net", previous("net", "start", 4), 2).alias("yoy_growth_pct")).orderBy("quarter")


@query("Promoted lines against full-price lines")
def q27_discount_impact(m: Retail) -> DataFrame:
    kind = F.when(F.col("promotion_id").isNull(), "No promotion").otherwise("Promotion applied")
    return sold_lines(m).groupBy(kind.alias("line_type")).agg(
        F.count("*").alias("order_lines"), F.sum("quantity").alias("units"),
        pct(F.sum("discount_amount"), F.sum("gross_amount"), 2).alias("discount_depth_pct"),
        pct(F.sum("gross_profit"), F.sum("net_revenue"), 2).alias("gross_margin_pct"),
        rnd(F.sum("discount_amount"), 0).alias("total_discount")).orderBy("line_type")


@query("Promotion uplift: daily units in the window against the days before")
def q28_promotion_uplift(m: Retail, before_days: int = 28) -> DataFrame:
    """Range join of order days with promotion windows. The product is the equi key and the date the residual; one pass
    covers the promotion window and the base window before it."""
    start, end = F.col("start_date"), F.col("end_date")
    promos = m.promotions.filter((F.date_sub(start, before_days) >= first_day(m)) & (end <= asof_day(m))).select(
        "promotion_id", "promo_code", "discount_type", "discount_value", "start_date", "end_date",
        (F.datediff(end, start) + 1).alias("promo_days"))
    eligible = m.product_promotions.join(promos.select("promotion_id", "start_date", "end_date"), "promotion_id")
    orders = completed(m).select("order_id", "order_day")
    lines = m.sales_order_items.select("order_id", "product_id", "quantity", "discount_amount").join(orders, "order_id")
    day = F.col("order_day")
    near = lines.join(eligible, "product_id").filter(day.between(F.date_sub(start, before_days), end))
    inside = day >= start
    by = near.groupBy("promotion_id").agg(
        F.sum(F.when(inside, F.col("quantity"))).alias("during"), F.sum(F.when(~inside, F.col("quantity"))).alias("base"),
        F.sum(F.when(inside, F.col("discount_amount"))).alias("given"))
    daily = ratio("during", "promo_days")
    return (promos.join(by.filter("during is not null and base is not null"), "promotion_id").orderBy("start_date").select(
        "promo_code", "discount_type", "discount_value", "promo_days", F.col("during").alias("units_during"),
        F.col("base").alias("units_28d_before"), rnd("given", 0).alias("discount_given"),
        growth_pct(daily, ratio("base", F.lit(before_days)), 1).alias("daily_unit_uplift_pct")))


@query("Basket size bands against order value")
def q29_basket_size(m: Retail) -> DataFrame:
    sizes = m.sales_order_items.groupBy("order_id").agg(F.count("*").alias("lines"))
    by = (completed(m).select("order_id", "total_amount").join(sizes, "order_id").groupBy(basket_label("lines").alias("basket_size"))
          .agg(F.count("*").alias("orders"), rnd(ratio(F.sum("total_amount"), F.count("*"))).alias("avg_order_value"),
               F.min("lines").alias("smallest")))
    return part_of_total(by, "orders", "share_of_orders_pct").orderBy("smallest").drop("smallest")


@query("Payment method mix and failure rate")
def q30_payment_mix(m: Retail) -> DataFrame:
    status = F.col("payment_status")
    by = m.payments.groupBy("payment_method").agg(
        F.count_if(status == "SUCCESS").alias("successful_payments"),
        rnd(F.sum(F.when(status == "SUCCESS", F.col("amount"))), 0).alias("amount_collected"),
        pct(F.count_if(status == "FAILED"), F.count_if(status != "REFUNDED"), 2).alias("failure_rate_pct"))
    return part_of_total(by, "successful_payments", "share_of_successful_pct").select(
        "payment_method", "successful_payments", "amount_collected", "share_of_successful_pct", "failure_rate_pct"
    ).orderBy(F.col("successful_payments").desc())


@query("Best month of every year")
def q31_best_month(m: Retail) -> DataFrame:
    best = monthly_revenue(m).groupBy(F.year("month").alias("yr")).agg(
        F.max(F.struct("net", (-F.unix_date("month")).alias("early"), "month")).alias("b"))
    return best.orderBy("yr").select(F.date_format("b.month", "yyyy-MM").alias("best_month"), rnd("b.net", 0).alias("revenue"))
