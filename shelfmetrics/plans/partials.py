"""Stored partial aggregates by month, so that a refresh reads the months that changed and no others.

Every measure here adds up over months: an order lies in one month and on one day, so numbers of orders by product and day can be summed as well. Each
partial is a plan of the model, run on the chosen months of orders and lines, and overwrites the folders of these months. ``from_partials`` gives the model
whose shared plans read the partials; datasets, queries and measures built on it need no other change. Trailing windows come from days, not months, so
they may begin on any day.

Refunds are by the day of the return, whose lines may be of any earlier month, and stay with the tables.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import inline_rows
from ..sources import Retail
from ..sources.layout import MONTH
from .datasets import asof_day, completed, monthly_lines, monthly_orders, orders_with_calendar, sold_lines, within


def day_bounds(m: Retail) -> DataFrame:
    return orders_with_calendar(m).groupBy("order_month").agg(F.min("order_day").alias("first_day"), F.max("order_day").alias("last_day"))


def customer_months(m: Retail) -> DataFrame:
    return completed(m).groupBy("order_month", "customer_id").agg(
        F.count("*").alias("orders"), F.sum("net_amount").alias("net_revenue"), F.sum("total_amount").alias("gross_sales"),
        F.min("order_day").alias("first_order_date"), F.max("order_day").alias("last_order_date"))


def profit_months(m: Retail) -> DataFrame:
    return sold_lines(m).groupBy("order_month", "customer_id").agg(F.sum("gross_profit").alias("gross_profit"))


def product_days(m: Retail) -> DataFrame:
    """Lines by product and day; orders are counted from (product, order)."""
    per_order = sold_lines(m).groupBy("product_id", "order_id").agg(
        F.sum("quantity").alias("units"), F.sum("net_revenue").alias("net"), F.sum("gross_profit").alias("profit"),
        F.sum("cogs").alias("cost"), F.min("order_day").alias("order_day"))
    return per_order.groupBy("product_id", "order_day").agg(
        F.count("*").alias("orders"), F.sum("units").alias("units"), F.sum("net").alias("net"), F.sum("profit").alias("profit"),
        F.sum("cost").alias("cost")).withColumn("order_month", F.trunc("order_day", "month"))


# partial: (plan, its column with the month)
PARTIALS: dict[str, tuple[Callable[[Retail], DataFrame], str]] = {
    "day_bounds": (day_bounds, "order_month"),
    "monthly_orders": (monthly_orders, "month"),
    "monthly_lines": (monthly_lines, "month"),
    "customer_months": (customer_months, "order_month"),
    "profit_months": (profit_months, "order_month"),
    "product_days": (product_days, "order_month"),
}
KNOWN = "_rows"  # false in the row that stands for a month without any


def of_months(m: Retail, months: list[str]) -> Retail:
    """The model with the orders and lines of these months (yyyy-MM); their folders are all that is read of both tables."""
    def some(table: str) -> DataFrame:
        rows = getattr(m, table)
        if MONTH not in rows.columns:
            raise ValueError(f"{table} is not stored by month")
        return rows.filter(F.col(MONTH).isin(months))

    return m.with_tables(sales_orders=some("sales_orders"), sales_order_items=some("sales_order_items"))


def new_months(m: Retail, root: str) -> list[str]:
    """Months with orders that the partials do not have. Both sides are names of folders, twelve a year."""
    here = m.sales_orders.select(MONTH).filter(F.col(MONTH).isNotNull()).distinct()
    try:
        done = m.spark.read.parquet(f"{root}/{list(PARTIALS)[-1]}").select(MONTH).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return sorted(r[0] for r in here.collect())
    return sorted(r[0] for r in here.join(done, MONTH, "left_anti").collect())


def refresh(m: Retail, root: str, months: list[str] | None = None) -> list[str]:
    """Bring the partials under ``root`` up to date for the given months (yyyy-MM), by default for those not yet there, and return them. Months whose
    orders or lines have changed have to be named; orders without a day belong to no month. Only folders of these months are replaced, one partial after
    the other, so a refresh that ended halfway is repeated; by default it then finds its months again, as the last partial still lacks them. A month
    that has lost all its rows is overwritten by a row that ``from_partials`` leaves out."""
    months = new_months(m, root) if months is None else sorted(set(months))
    if not months:
        return []
    part = of_months(m, months)
    every = inline_rows(m.spark, [(x,) for x in months], f"{MONTH} string").withColumn(KNOWN, F.lit(False))
    for name, (plan, month) in PARTIALS.items():
        rows = plan(part)
        stored = rows.select("*", F.date_format(month, "yyyy-MM").alias(MONTH), F.lit(True).alias(KNOWN))
        out = stored.unionByName(every, allowMissingColumns=True)
        # A range over month and first column: few files a month, and a large month is spread over tasks.
        (out.repartitionByRange(MONTH, rows.columns[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(MONTH).parquet(f"{root}/{name}"))
    return months


def from_partials(m: Retail, root: str) -> Retail:
    """The model whose first and last day, monthly sums, buyers, customers' profit and product sales come from the partials."""
    def stored(name: str) -> DataFrame:
        return m.spark.read.parquet(f"{root}/{name}").filter(KNOWN).drop(KNOWN, MONTH)

    bounds = stored("day_bounds").agg(F.min("first_day").alias("first_order_date"), F.max("last_day").alias("asof_date"))
    per_customer = stored("customer_months").groupBy("customer_id").agg(
        F.sum("orders").alias("orders"), F.sum("net_revenue").alias("net_revenue"), F.sum("gross_sales").alias("gross_sales"),
        F.min("first_order_date").alias("first_order_date"), F.max("last_order_date").alias("last_order_date"))
    profit = stored("profit_months").groupBy("customer_id").agg(F.sum("gross_profit").alias("gross_profit"))
    last = asof_day(m.with_plans(order_days=bounds))
    recent, year = within(F.col("order_day"), last, 90), within(F.col("order_day"), last, 365)
    sales = stored("product_days").groupBy("product_id").agg(
        F.sum("orders").alias("orders"), F.sum("units").alias("units_sold"), F.sum("net").alias("net_revenue"),
        F.sum("profit").alias("gross_profit"), F.min("order_day").alias("first_sale_date"), F.max("order_day").alias("last_sale_date"),
        F.sum(F.when(recent, F.col("units"))).alias("units_90d"), F.sum(F.when(year, F.col("net"))).alias("revenue_12m"),
        F.sum(F.when(year, F.col("cost"))).alias("cogs_12m"))
    return m.with_plans(order_days=bounds, monthly_orders=stored("monthly_orders"), monthly_lines=stored("monthly_lines"),
                        buyer_totals=per_customer, customer_profit=profit, product_sales=sales)
