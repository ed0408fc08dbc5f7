"""Selective lookups (Q501-Q517). Filters are written on stored columns and as half-open ranges, so they reach the scan;
``sources.layout`` writes the tables so that such filters also skip files and partitions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import Retail
from ..sources.layout import between_days
from .advanced import far_above_average
from .datasets import completed
from .registry import query
from .sales import monthly_revenue


def day(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("One customer's order history")
def q501_customer_history(m: Retail, customer_id: int = 4104) -> DataFrame:
    return completed(m).filter(F.col("customer_id") == customer_id).select("order_id", "order_date", "total_amount").orderBy("order_date", "order_id")


@query("Revenue in one month")
def q502_month_revenue(m: Retail, first: str = "2025-10-01", until: str = "2025-11-01") -> DataFrame:
    return between_days(completed(m), day(first), day(until)).agg(
        F.count("*").alias("orders"), F.sum("net_amount").alias("net_revenue"))


@query("All sales lines of one product")
def q503_product_lines(m: Retail, product_id: int = 13) -> DataFrame:
    return m.sales_order_items.filter(F.col("product_id") == product_id).agg(F.sum("quantity").alias("units"), F.sum("line_total").alias("line_total"))


@query("Large orders against the customer's own average, as a correlated subquery")
def q504_correlated_average(m: Retail, floor: float = 100000, times: float = 3) -> DataFrame:
    """Catalyst turns the equality-correlated scalar subquery into an aggregate and a join."""
    return m.spark.sql(
        "SELECT o.order_id, o.total_amount FROM {orders} o WHERE o.order_status = 'COMPLETED' AND o.total_amount > {floor}"
        " AND cast(o.total_amount AS double) > {times} * (SELECT cast(sum(a.total_amount) AS double) / count(*) FROM {orders} a"
        " WHERE a.customer_id = o.customer_id AND a.order_status = 'COMPLETED')",
        orders=m.sales_orders.select("order_id", "customer_id", "total_amount", "order_status"), floor=floor, times=times)


@query("Returned quantity of one product")
def q505_product_returns(m: Retail, product_id: int = 13) -> DataFrame:
    lines = m.keyed("sales_order_items").filter(F.col("product_id") == product_id).select("order_item_id", "product_id")
    return m.keyed("return_items").select("order_item_id", "quantity").join(lines, "order_item_id").groupBy("product_id").agg(
        F.sum("quantity").alias("units_returned"))


@query("Ledger of one store and product in date order")
def q506_position_ledger(m: Retail, store_id: int = 3, product_id: int = 13) -> DataFrame:
    return m.inventory_transactions.filter((F.col("store_id") == store_id) & (F.col("product_id") == product_id)).select(
        "transaction_date", "transaction_type", "quantity_change").orderBy("transaction_date", "transaction_type")


@query("Completed orders without a payment")
def q507_unpaid_orders(m: Retail) -> DataFrame:
    return completed(m).select("order_id").join(m.payments.select("order_id"), "order_id", "left_anti").agg(F.count("*").alias("orders"))


@query("Open purchase orders by due date")
def q508_open_purchases(m: Retail) -> DataFrame:
    return m.purchases.filter(F.col("status") == "ORDERED").select("purchase_id", "supplier_id", "expected_date").orderBy("expected_date", "purchase_id")


@query("Case-insensitive e-mail lookup")
def q509_email_lookup(m: Retail, email: str = "abhishek.patil187@example.com") -> DataFrame:
    """A table laid out with ``email_norm`` is filtered on that column, which the scan can use."""
    stored = "email_norm" in m.customers.columns
    return m.customers.filter((F.col("email_norm") if stored else F.lower("email")) == email.lower()).select("customer_id", "email")


@query("One store, one quarter")
def q510_store_quarter(m: Retail, store_id: int = 3, first: str = "2025-07-01", until: str = "2025-10-01") -> DataFrame:
    return between_days(m.sales_orders, day(first), day(until)).filter(F.col("store_id") == store_id).agg(
        F.count("*").alias("orders"), F.sum("total_amount").alias("total_amount"))


@query("Monthly revenue over the full table")
def q511_full_scan(m: Retail) -> DataFrame:
    return monthly_revenue(m).select("month", F.col("net").alias("net_revenue")).orderBy("month")


@query("Stock of one product across stores")
def q512_product_stock(m: Retail, product_id: int = 13) -> DataFrame:
    return m.inventory.filter(F.col("product_id") == product_id).agg(F.sum("quantity_on_hand").alias("units"))


@query("Products of one category")
def q513_category_products(m: Retail, category_id: int = 1) -> DataFrame:
    return m.products.filter(F.col("category_id") == category_id).select("product_id", "product_name")


@query("Returns of one order")
def q514_order_returns(m: Retail, order_id: int = 20000) -> DataFrame:
    return m.keyed("returns").filter(F.col("order_id") == order_id).select("return_id", "return_date", "refund_amount")


@query("Payments of one order")
def q515_order_payments(m: Retail, order_id: int = 20000) -> DataFrame:
    return m.payments.filter(F.col("order_id") == order_id).select("payment_id", "payment_method", "amount", "payment_status")


@query("Return lines of one sold line")
def q516_line_returns(m: Retail, order_item_id: int | str = 58934) -> DataFrame:
    return m.keyed("return_items").filter(F.col("order_item_id") == order_item_id).select("return_item_id", "quantity", "refund_amount")


@query("Large orders against the customer's own average, pre-aggregated")
def q517_preaggregated_average(m: Retail, floor: float = 100000, times: float = 3) -> DataFrame:
    return far_above_average(m, floor, times).select("order_id", "total_amount")
