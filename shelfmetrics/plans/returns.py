"""How much is returned, where and by whom (Q89-Q99)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import band, month_of, one_row, part_of_total, pct, rnd, top
from ..operators import percentiles
from ..sources import Retail
from .customers import with_segment
from .datasets import (canonical_products, completed, elapsed_days, flag_returns, returned_lines, units_returned)
from .registry import query
from .sales import monthly_revenue, product_totals
from .stores import store_names


@query("Return rate by orders, units and value")
def q89_return_rates(m: Retail) -> DataFrame:
    sold = m.sales_order_items.select("order_id", "quantity").join(completed(m).select("order_id"), "order_id")
    row = one_row(
        completed(m).agg(F.count("*").alias("done"), F.sum("net_amount").alias("net")),
        m.returns.select("order_id").distinct().agg(F.count("*").alias("back")),
        returned_lines(m).agg(F.sum("units_returned").alias("units_back"), F.sum("refund_net").alias("value")),
        sold.agg(F.sum("quantity").alias("units")))
    return row.select(
        F.col("done").alias("completed_orders"), F.col("back").alias("orders_with_returns"), pct("back", "done", 2).alias("order_return_rate_pct"),
        pct("units_back", "units", 2).alias("unit_return_rate_pct"), rnd("value", 0).alias("returned_value_net"),
        pct("value", "net", 2).alias("value_return_rate_pct"))


@query("Return reasons")
def q90_return_reasons(m: Retail) -> DataFrame:
    by = m.returns.groupBy("return_reason").agg(F.count("*").alias("returns"), rnd(F.sum("refund_amount"), 0).alias("refund_value"))
    return part_of_total(by, "returns", "share_of_returns_pct", 1).orderBy(F.col("returns").desc())


def merged_categories(m: Retail) -> DataFrame:
    return canonical_products(m).filter(F.col("canonical_id").isNotNull()).select(
        "product_id", "canonical_id", F.col("canonical_name").alias("category_name"))


@query("Unit return rate by category")
def q91_returns_by_category(m: Retail) -> DataFrame:
    cats = merged_categories(m)
    sold = product_totals(m).select("product_id", "units").join(cats, "product_id").groupBy("canonical_id", "category_name").agg(
        F.sum("units").alias("units_sold"))
    back = (returned_lines(m).groupBy("product_id").agg(F.sum("units_returned").alias("u"), F.sum("refund_amount").alias("r"))
            .join(cats, "product_id").groupBy("canonical_id").agg(F.sum("u").alias("u"), F.sum("r").alias("r")))
    zero = F.lit(0)
    return sold.join(back, "canonical_id", "left").select(
        "category_name", "units_sold", F.coalesce("u", zero).alias("units_returned"), pct(F.coalesce("u", zero), "units_sold", 2).alias(
            "unit_return_rate_pct"), rnd(F.coalesce("r", zero), 0).alias("refund_value")).orderBy(F.col("unit_return_rate_pct").desc())


def order_return_rate(df: DataFrame, *keys: str) -> DataFrame:
    """Every order is one row with its flag, so plain counts replace distinct counts over a fan-out."""
    return df.groupBy(*keys).agg(F.count("*").alias("completed_orders"), F.count_if("has_return").alias("orders_with_returns"),
                                 pct(F.count_if("has_return"), F.count("*"), 2).alias("order_return_rate_pct"))


@query("Order return rate by store against the company")
def q92_returns_by_store(m: Retail) -> DataFrame:
    company = pct(m.returns.select("order_id").distinct().agg(F.count("*")).scalar(), completed(m).agg(F.count("*")).scalar(), 2)
    by = order_return_rate(flag_returns(m, completed(m)), "store_id")
    return by.join(store_names(m), "store_id").select(
        "store_name", "completed_orders", "orders_with_returns", "order_return_rate_pct", company.alias("company_rate_pct")
    ).orderBy(F.col("order_return_rate_pct").desc())


@query("Order return rate by customer segment")
def q93_returns_by_segment(m: Retail) -> DataFrame:
    per = flag_returns(m, completed(m)).groupBy("customer_id").agg(F.count("*").alias("n"), F.count_if("has_return").alias("r"))
    by = with_segment(m, per).groupBy("segment").agg(F.sum("n").alias("completed_orders"), F.sum("r").alias("orders_with_returns"))
    return by.withColumn("order_return_rate_pct", pct("orders_with_returns", "completed_orders", 2)).orderBy(F.col("order_return_rate_pct").desc())


@query("Products returned far more often than their category")
def q94_unusual_returns(m: Retail, min_units: int = 40, min_returned: int = 8, times: float = 2.5, n: int = 15) -> DataFrame:
    done = completed(m).select(F.col("order_id").alias("line_order_id"))
    back = returned_lines(m).join(done, "line_order_id", "left_semi").groupBy("product_id").agg(F.sum("units_returned").alias("u"))
    kinds = m.products.select("product_id", "product_name", F.coalesce("category_id", F.lit(0)).alias("category_id"))
    per = product_totals(m).select("product_id", "units").join(back, "product_id", "left").join(kinds, "product_id").withColumn(
        "u", F.coalesce("u", F.lit(0)))
    benchmark = per.groupBy("category_id").agg(pct(F.sum("u"), F.sum("units")).alias("cat_rate"))
    rated = per.join(benchmark, "category_id").withColumn("rate", pct("u", "units"))
    hit = rated.filter((F.col("units") >= min_units) & (F.col("u") >= min_returned) & (F.col("rate") >= times * F.col("cat_rate")))
    worse = F.round(F.col("rate") / F.nullif("cat_rate", F.lit(0.0)), 1)
    return top(hit, n, worse.desc(), F.col("product_id")).select(
        "product_name", F.col("units").alias("units_sold"), F.col("u").alias("units_returned"), rnd("rate", 1).alias("return_rate_pct"),
        rnd("cat_rate", 1).alias("category_rate_pct"), worse.alias("times_category_rate"))


@query("Refunds per month against revenue")
def q95_refunds_per_month(m: Retail) -> DataFrame:
    refunds = (returned_lines(m).join(m.keyed("returns").select("return_id", "return_date"), "return_id")
               .groupBy(month_of("return_date").alias("month")).agg(F.sum("refund_net").alias("back")))
    back = F.coalesce("back", F.lit(0.0))
    return monthly_revenue(m).join(refunds, "month", "left").select(
        "month", rnd("net", 0).alias("net_revenue"), rnd(back, 0).alias("refunded_net"), pct(back, "net", 2).alias("refund_pct_of_revenue")
    ).orderBy("month")


@query("Days from purchase to return, in bands with their median")
def q96_days_to_return(m: Retail) -> DataFrame:
    days = m.returns.select("order_id", "return_date").join(m.sales_orders.select("order_id", "order_date"), "order_id").select(
        elapsed_days("order_date", "return_date").alias("days")).withColumn(
        "return_window", band("days", [(3, "a) within 3 days"), (7, "b) 3-6 days"), (15, "c) 7-14 days")], "d) 15+ days"))
    by = days.groupBy("return_window").agg(F.count("*").alias("returns"))
    middle = percentiles(days, "days", {"median": 0.5}, by=["return_window"])
    return part_of_total(by, "returns", "share_pct", 1).join(middle, "return_window").select(
        "return_window", "returns", "share_pct", rnd("median", 1).alias("median_days")).orderBy("return_window")


@query("Restocked against written-off returns")
def q97_restocked(m: Retail) -> DataFrame:
    label = F.when(F.col("restocked"), "Restocked (resellable)").otherwise("Not restocked (write-off)")
    by = returned_lines(m).groupBy("restocked").agg(
        F.count("*").alias("return_lines"), F.sum("units_returned").alias("units"), F.sum("cost_value").alias("v"))
    return part_of_total(by, "v", "share_of_cost_pct", 1).orderBy(F.col("restocked").desc()).select(
        label.alias("outcome"), "return_lines", "units", rnd("v", 0).alias("cost_value"), "share_of_cost_pct")


@query("Order return rate by channel")
def q98_returns_by_channel(m: Retail) -> DataFrame:
    return order_return_rate(flag_returns(m, completed(m)), "channel")


@query("Most common return reason of each category")
def q99_top_reason(m: Retail) -> DataFrame:
    header = m.keyed("returns").select("return_id", "return_reason")
    once = returned_lines(m).join(header, "return_id").join(merged_categories(m), "product_id").select(
        "canonical_id", "category_name", "return_reason", "return_id").distinct()
    by = once.groupBy("canonical_id", "category_name", "return_reason").agg(F.count("*").alias("n"))
    best = by.groupBy("canonical_id", "category_name").agg(
        F.max(F.struct("n", "return_reason")).alias("b"), F.sum("n").alias("whole"))
    return best.select("category_name", F.col("b.return_reason").alias("most_common_reason"), F.col("b.n").alias("returns"),
                       pct("b.n", "whole", 1).alias("share_of_category_returns_pct")).orderBy("category_name")
