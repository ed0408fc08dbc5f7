"""Store scorecards, rankings, growth and staff (Q72-Q80)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import as_double, growth_pct, pct, ratio, rnd
from ..sources import Retail
from ..sources.layout import since
from .datasets import NO_CATEGORY, asof_day, completed, first_day, months_open, sold_lines, stock_value
from .products import yearly_revenue
from .registry import query
from .sales import revenue_by_store


def store_names(m: Retail) -> DataFrame:
    return m.stores.select("store_id", "store_name")


@query("Store scorecard")
def q72_store_scorecard(m: Retail) -> DataFrame:
    per = completed(m).groupBy("store_id", "customer_id").agg(
        F.count("*").alias("n"), F.sum("net_amount").alias("net"), F.sum("total_amount").alias("gross"))
    sales = per.groupBy("store_id").agg(
        F.sum("n").alias("orders"), F.count("*").alias("customers"), F.count_if(F.col("n") >= 2).alias("repeat"),
        F.sum("net").alias("net"), F.sum("gross").alias("gross"))
    units = (m.sales_order_items.select("order_id", "quantity").join(completed(m).select("order_id", "store_id"), "order_id")
             .groupBy("store_id").agg(F.sum("quantity").alias("units")))
    back = (m.sales_orders.select("order_id", "store_id").join(m.returns.select("order_id"), "order_id", "left_semi")
            .groupBy("store_id").agg(F.count("*").alias("back")))
    stock = stock_value(m).groupBy("store_id").agg(F.sum("value").alias("v"))
    return (store_names(m).join(sales, "store_id").join(units, "store_id").join(back, "store_id", "left").join(stock, "store_id")
            .orderBy(F.col("net").desc()).select(
        "store_name", "orders", "units", rnd("net", 0).alias("net_revenue"), rnd(ratio("gross", "orders"), 0).alias("avg_order_value"),
        "customers", pct("repeat", "customers", 1).alias("repeat_customer_rate_pct"),
        pct(F.coalesce("back", F.lit(0)), "orders", 2).alias("return_rate_pct"), rnd("v", 0).alias("inventory_value")))


@query("Store rank per month, latest three months")
def q73_monthly_store_rank(m: Retail, months: int = 3) -> DataFrame:
    newest = F.trunc(completed(m).agg(F.max("order_day")).scalar(), "month")
    recent = since(completed(m), F.add_months(newest, 1 - months), "order_day")
    by = recent.groupBy(F.col("order_month").alias("month"), "store_id").agg(F.sum("net_amount").alias("net"))
    ranked = by.withColumn("revenue_rank", F.rank().over(Window.partitionBy("month").orderBy(F.col("net").desc())))
    return ranked.join(store_names(m), "store_id").select("month", "store_name", rnd("net", 0).alias("revenue"), "revenue_rank").orderBy(
        "month", "revenue_rank")


@query("Store growth over the year before, for stores open before it")
def q74_store_growth(m: Retail, before: int = 2024, year: int = 2025) -> DataFrame:
    old, new = f"rev_{before}", f"rev_{year}"
    by = yearly_revenue(completed(m), (before, year), "store_id", measure="net_amount")
    known = m.stores.filter(F.col("opened_date") < F.make_date(F.lit(before), F.lit(1), F.lit(1))).select("store_id", "store_name", "opened_date")
    return by.join(known, "store_id").select(
        "store_name", "opened_date", rnd(old, 0).alias(f"revenue_{before}"), rnd(new, 0).alias(f"revenue_{year}"),
        growth_pct(new, old, 1).alias("growth_pct")).orderBy("growth_pct")


@query("Revenue by region and state with subtotals")
def q75_region_rollup(m: Retail) -> DataFrame:
    by = revenue_by_store(m).join(m.stores.select("store_id", "region", "state"), "store_id")
    rolled = by.rollup("region", "state").agg(
        F.sum("orders").alias("orders"), rnd(F.sum("net"), 0).alias("net_revenue"), F.grouping("region").alias("gr"),
        F.grouping("state").alias("gs"))
    return rolled.orderBy("gr", "region", "gs", F.col("net_revenue").desc()).select(
        F.coalesce("region", F.lit("ALL REGIONS")).alias("region"), F.when(F.col("gs") == 1, "subtotal").otherwise(F.col("state")).alias("state"),
        "orders", "net_revenue")


@query("Revenue per operating month against the peer average")
def q76_revenue_per_month(m: Retail) -> DataFrame:
    start, end = first_day(m), asof_day(m)
    by = (revenue_by_store(m).join(m.stores.filter(F.col("store_type") == "STORE").select("store_id", "store_name", "opened_date"), "store_id")
          .withColumn("open", months_open(F.col("opened_date"), start, end)).withColumn("per", as_double("net") / F.col("open")))
    return by.select(
        "store_name", "opened_date", rnd("open", 1).alias("months_open"), rnd("net", 0).alias("revenue"), rnd("per", 0).alias("revenue_per_month"),
        pct("per", F.avg("per").over(Window.partitionBy()), 0).alias("index_vs_peer_average")).orderBy("revenue_per_month")


@query("Best salesperson of every store, with the manager")
def q77_best_salesperson(m: Retail) -> DataFrame:
    per = completed(m).filter(F.col("employee_id").isNotNull()).groupBy("store_id", "employee_id").agg(
        F.count("*").alias("orders"), F.sum("net_amount").alias("net"))
    best = per.groupBy("store_id").agg(F.max(F.struct("net", (-F.col("employee_id")).alias("k"), "employee_id", "orders")).alias("b"))
    full = F.concat("first_name", F.lit(" "), "last_name")
    staff = m.employees.select("employee_id", full.alias("top_employee"), "job_title", F.col("manager_id").alias("boss"))
    bosses = m.employees.select(F.col("employee_id").alias("boss"), full.alias("reports_to"))
    return (best.select("store_id", "b.*").join(staff, "employee_id").join(bosses, "boss", "left").join(store_names(m), "store_id")
            .orderBy(F.col("net").desc()).select("store_name", "top_employee", "job_title", "reports_to", "orders", rnd("net", 0).alias("net_revenue")))


@query("Leading category of each store")
def q78_leading_category(m: Retail) -> DataFrame:
    cats = m.products.select("product_id", "category_id").join(m.categories.select("category_id", "category_name"), "category_id", "left").select(
        "product_id", F.coalesce("category_name", F.lit(NO_CATEGORY)).alias("category"))
    by = sold_lines(m).groupBy("store_id", "product_id").agg(F.sum("net_revenue").alias("n")).join(cats, "product_id").groupBy(
        "store_id", "category").agg(F.sum("n").alias("net"))
    best = by.groupBy("store_id").agg(F.max_by("category", F.struct("net", "category")).alias("leading_category"),
                                      F.max("net").alias("net"), F.sum("net").alias("whole"))
    return best.join(store_names(m), "store_id").select(
        "store_name", "leading_category", rnd("net", 0).alias("revenue"), pct("net", "whole", 1).alias("share_of_store_pct")).orderBy("store_name")


@query("Average order value: store against company")
def q79_order_value_gap(m: Retail, min_orders: int = 500) -> DataFrame:
    company = completed(m).agg(ratio(F.sum("total_amount"), F.count("*"))).scalar()
    own = ratio("gross", "orders")
    return revenue_by_store(m).filter(F.col("orders") > min_orders).join(store_names(m), "store_id").select(
        "store_name", "orders", rnd(own, 0).alias("store_aov"), rnd(company, 0).alias("company_aov"),
        growth_pct(own, company, 1).alias("difference_pct")).orderBy(F.col("difference_pct").desc())


@query("Revenue per active employee by store")
def q80_revenue_per_employee(m: Retail) -> DataFrame:
    staff = m.employees.groupBy("store_id").agg(F.count_if("is_active").alias("active_employees"))
    return revenue_by_store(m).join(staff, "store_id").join(store_names(m), "store_id").select(
        "store_name", "active_employees", rnd("net", 0).alias("net_revenue"),
        rnd(ratio("net", "active_employees"), 0).alias("revenue_per_active_employee")).orderBy(F.col("revenue_per_active_employee").desc())
