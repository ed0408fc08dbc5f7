"""The twelve canonical datasets. Each is a function of the model and the only definition of its metrics.

Facts are aggregated at their own grain before they are joined, dimensions are joined after the aggregation wherever the
measure allows it, and no join is forced to broadcast but bits of keys, which are measured: small dimensions are picked by size, by Catalyst or by AQE.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import (as_double, cover_days, day_of, growth_pct, month_of, net_of_tax, no_zero, pct, ratio, rnd, title_name)
from ..operators import KNOWN, KeyBits, abc_classes, cut_lineage, flagged, previous, quantile_buckets, stored_columns
from ..sources import Retail, shared
from ..sources.layout import MONTH, order_key, since

NO_CATEGORY, NO_BRAND, NO_SUPPLIER, NO_SEGMENT = "(no category)", "(brand missing)", "(supplier missing)", "(no segment)"

# Fixed thresholds of the business rules.
RECENCY_LIMITS = [(30, 5), (90, 4), (180, 3), (365, 2)]
FREQUENCY_FLOORS = [(13, 5), (7, 4), (4, 3), (2, 2)]
HEALTH_STATUSES = ["OUT_OF_STOCK", "LOW_STOCK", "HEALTHY", "OVERSTOCKED", "DEAD_STOCK"]
RFM_LABELS = ["Champions", "Loyal Customers", "Potential Loyalists", "At Risk", "Lost Customers"]
ACTIVITY_LABELS = ["Active (last 90 days)", "Inactive (91-365 days)", "Lost (over 365 days)", "Never purchased"]


# ---- building blocks -------------------------------------------------------------------------------------------------

@shared
def order_days(m: Retail) -> DataFrame:
    """First and last order day over all orders: one row."""
    return m.sales_orders.agg(F.min("order_date").cast("date").alias("first_order_date"),
                              F.max("order_date").cast("date").alias("asof_date"))


def asof_day(m: Retail) -> Column:
    """Last order day over all orders, as a scalar subquery."""
    return order_days(m).select("asof_date").scalar()


def first_day(m: Retail) -> Column:
    return order_days(m).select("first_order_date").scalar()


def within(day: Column, asof: Column, days: int) -> Column:
    """Trailing window with an exclusive lower bound."""
    return day > F.date_sub(asof, days)


@shared
def orders_with_calendar(m: Retail) -> DataFrame:
    day = day_of("order_date")
    return m.sales_orders.withColumns({
        "order_day": day, "order_month": F.trunc(day, "month"), "order_year": F.year(day),
        "net_amount": F.col("total_amount") - F.col("gst_amount")})


@shared
def completed(m: Retail) -> DataFrame:
    return orders_with_calendar(m).filter(F.col("order_status") == "COMPLETED")


@shared
def sold_lines(m: Retail) -> DataFrame:
    """Lines of completed orders with their money measures. The GST rate is taken from the line where the line records
    it, and from the product otherwise; only then is the product table joined."""
    return _sold(m, m.sales_order_items)


@shared
def sold_lines_keyed(m: Retail) -> DataFrame:
    """The same with order_item_id."""
    return _sold(m, m.keyed("sales_order_items"))


def sold_lines_of(m: Retail, goods: DataFrame) -> DataFrame:
    """The same with attributes of the product. They meet the line before its order does, so that what follows lies by order and a distinct count of
    orders needs no shuffle of its own."""
    return _sold(m, m.sales_order_items.join(goods, "product_id"))


def sold_lines_flagged(m: Retail, bits: KeyBits, *flags: str, goods: DataFrame | None = None) -> DataFrame:
    """Sold lines with flags of their order in place of its attributes; no table of orders is met. Money is made of its parts only where goods have been met."""
    lines = flagged(_rated(m, m.sales_order_items), "order_id", bits, "completed", *flags).withColumn("net_revenue", net_of_tax("line_total", "gst_rate"))
    lines = (lines if goods is None else lines.join(goods, "product_id")).withColumn("cogs", F.col("quantity") * F.col("unit_cost"))
    return lines.withColumn("gross_profit", F.col("net_revenue") - as_double("cogs"))


def _rated(m: Retail, items: DataFrame) -> DataFrame:
    return items if "gst_rate" in items.columns else items.join(m.products.select("product_id", "gst_rate"), "product_id")


def _sold(m: Retail, items: DataFrame) -> DataFrame:
    items = _rated(m, items.withColumnRenamed("discount_amount", "line_discount"))
    orders = completed(m).select("order_id", "order_date", "order_day", "order_month", "order_year", "store_id", "customer_id",
                                 "channel", *[c for c in ("employee_id", MONTH) if c in m.sales_orders.columns])
    lines = items.join(orders, order_key(items, orders))
    net, cogs = net_of_tax("line_total", "gst_rate"), F.col("quantity") * F.col("unit_cost")
    return lines.withColumns({
        "gross_amount": F.col("quantity") * F.col("unit_price"), "net_revenue": net, "cogs": cogs,
        "gross_profit": net - as_double(cogs)}).withColumnRenamed("line_discount", "discount_amount")


@shared
def returned_lines(m: Retail) -> DataFrame:
    """Return lines with the sold line they refer to: product, cost and refund without GST."""
    return _returned(m, m.keyed("return_items"))


def returned_lines_flagged(m: Retail, bits: KeyBits) -> DataFrame:
    """Return lines whose return and its order are known, without the attributes of either: the lines that ``returned_sales`` gives."""
    header = flagged(m.keyed("returns").select("return_id", "order_id"), "order_id", bits, KNOWN).select("return_id")
    return _rounded(_returned(m, m.keyed("return_items").join(header, "return_id")))


def _rounded(back: DataFrame) -> DataFrame:
    return back.withColumns({"refund_net_of_gst": rnd("refund_net"), "cost_value": rnd("cost_value")})


def _returned(m: Retail, items: DataFrame) -> DataFrame:
    sold = _rated(m, m.keyed("sales_order_items")).select(
        "order_item_id", F.col("order_id").alias("line_order_id"), "product_id", "unit_cost", "gst_rate", F.col("quantity").alias("units_in_line"))
    back = items.withColumnRenamed("quantity", "units_returned").join(sold, "order_item_id")
    return back.withColumns({"refund_net": net_of_tax("refund_amount", "gst_rate"),
                             "cost_value": F.col("units_returned") * F.col("unit_cost")})


def units_returned(m: Retail, key: str = "product_id") -> DataFrame:
    return returned_lines(m).groupBy(key).agg(F.sum("units_returned").alias("units_returned"))


@shared
def canonical_products(m: Retail) -> DataFrame:
    """Products with their merged category: canonical id and name, NULL for products without one."""
    canon = category_canonical(m).select("category_id", "canonical_id", "canonical_name")
    return m.products.join(canon, "category_id", "left")


@shared
def stock_value(m: Retail) -> DataFrame:
    """Stock positions with product cost and value."""
    cost = m.products.select("product_id", "unit_cost")
    return m.inventory.join(cost, "product_id").withColumn("value", F.col("quantity_on_hand") * F.col("unit_cost"))


def demand(m: Retail, by: list[str], short: int = 90, long: int = 365, bits: KeyBits | None = None) -> DataFrame:
    """Units sold in the trailing windows; only lines of the long window are read past the join. ``bits`` has them as ``recent``: then no others meet it."""
    asof = asof_day(m)
    start = F.date_add(asof, 1 - long)
    if "product_orders" in m.given:
        lines = m.given["product_orders"].filter(F.col("order_day") >= start)
    else:
        key = order_key(m.sales_orders, m.sales_order_items)
        orders = since(completed(m), start, "order_day").select(*key, "store_id", "order_day")
        lines = m.sales_order_items.select(*key, "product_id", "quantity")
        lines = (lines if bits is None else flagged(lines, "order_id", bits, "recent")).join(orders, key)
    recent = within(F.col("order_day"), asof, short)
    return lines.groupBy(*by).agg(F.sum(F.when(recent, F.col("quantity"))).alias("units_90d"), F.sum("quantity").alias("units_365d"))


@shared
def position_demand(m: Retail) -> DataFrame:
    return demand(m, ["store_id", "product_id"])


@shared
def open_inbound(m: Retail) -> DataFrame:
    return inbound(m)


def inbound(m: Retail, bits: KeyBits | None = None) -> DataFrame:
    """Units on order by position; with ``bits`` of purchases only the items of open ones are shuffled."""
    open_pos = m.purchases.filter(F.col("status") == "ORDERED").select("purchase_id", "store_id")
    items = m.purchase_items if bits is None else flagged(m.purchase_items, "purchase_id", bits, "open")
    return items.join(open_pos, "purchase_id").groupBy("store_id", "product_id").agg(F.sum("quantity_ordered").alias("inbound_qty"))


def health_status(on_hand: Column, reorder: Column, ceiling: Column, units_90d: Column, units_365d: Column) -> Column:
    """First matching rule wins."""
    daily = as_double(F.coalesce(units_90d, F.lit(0))) / 90 + 0.000001
    return (F.when(on_hand == 0, "OUT_OF_STOCK")
            .when(F.coalesce(units_365d, F.lit(0)) == 0, "DEAD_STOCK")
            .when(on_hand <= reorder, "LOW_STOCK")
            .when((on_hand > ceiling) | (as_double(on_hand) / daily > 180), "OVERSTOCKED")
            .otherwise("HEALTHY"))


@shared
def positions(m: Retail) -> DataFrame:
    """Stock positions with value, demand and health."""
    stock = stock_value(m).join(position_demand(m), ["store_id", "product_id"], "left")
    return stock.withColumn("status", health_status(
        F.col("quantity_on_hand"), F.col("reorder_level"), F.col("max_stock_level"), F.col("units_90d"), F.col("units_365d")))


def recency_score(days: Column) -> Column:
    out = None
    for limit, score in RECENCY_LIMITS:
        out = F.when(days <= limit, score) if out is None else out.when(days <= limit, score)
    return out.otherwise(1)


def frequency_score(orders: Column) -> Column:
    out = None
    for floor, score in FREQUENCY_FLOORS:
        out = F.when(orders >= floor, score) if out is None else out.when(orders >= floor, score)
    return out.otherwise(1)


def rfm_label(r: Column, f: Column) -> Column:
    best, loyal, fresh, risk, lost = RFM_LABELS
    return (F.when((r >= 4) & (f >= 4), best).when((r >= 3) & (f >= 3), loyal).when((r >= 3) & (f <= 2), fresh)
            .when((r <= 2) & (f >= 3), risk).otherwise(lost))


def stock_class(quintile: Column, units_90d: Column, in_stock: Column) -> Column:
    cover = cover_days(in_stock, units_90d)
    high, low, moving = quintile == 5, quintile <= 2, units_90d > 0
    return (F.when(high & moving & (cover < 30), "High Revenue / Low Stock")
            .when(high & moving & cover.between(30, 180), "High Revenue / Healthy Stock")
            .when(low & (~moving | (cover > 180)), "Low Revenue / High Stock")
            .when(low & moving & (cover < 30), "Low Revenue / Low Stock").otherwise("Other"))


@shared
def segment_names(m: Retail) -> DataFrame:
    return m.customer_segments.select("segment_id", "segment_name")


# ---- the datasets ----------------------------------------------------------------------------------------------------

def asof(m: Retail) -> DataFrame:
    return order_days(m)


@shared
def category_canonical(m: Retail) -> DataFrame:
    same_name = Window.partitionBy(F.lower("category_name"))
    up = m.categories.select(F.col("category_id").alias("parent_category_id"), F.col("category_name").alias("parent_category"))
    return m.categories.join(up, "parent_category_id", "left").select(
        "category_id", F.min("category_id").over(same_name).alias("canonical_id"),
        F.first("category_name").over(same_name.orderBy("category_id")).alias("canonical_name"), "parent_category")


def sales_lines(m: Retail) -> DataFrame:
    products = canonical_products(m).select("product_id", "canonical_id", "canonical_name")
    return sold_lines_keyed(m).join(products, "product_id").select(
        "order_id", "order_item_id", "order_date", "order_day", "order_month", "order_year", "store_id", "customer_id",
        "channel", "employee_id", "product_id", F.coalesce("canonical_id", F.lit(0)).alias("category_id"),
        F.coalesce("canonical_name", F.lit(NO_CATEGORY)).alias("category_name"), "promotion_id", "quantity", "unit_price",
        "unit_cost", "discount_amount", "gross_amount", F.col("line_total").alias("line_total_incl_gst"), "net_revenue",
        "cogs", "gross_profit")


def flag_returns(m: Retail, orders: DataFrame) -> DataFrame:
    """Boolean has_return by a left join to the distinct returned orders."""
    returned = m.returns.select("order_id").distinct().withColumn("_r", F.lit(True))
    return orders.join(returned, "order_id", "left").withColumn("has_return", F.col("_r").isNotNull()).drop("_r")


def orders(m: Retail) -> DataFrame:
    customers = m.customers.select("customer_id", "segment_id").join(segment_names(m), "segment_id", "left")
    out = (orders_with_calendar(m).join(m.stores.select("store_id", "store_name"), "store_id").join(customers, "customer_id"))
    return flag_returns(m, out).select(
        "order_id", "order_number", "order_date", "order_day", "order_month", "customer_id", "store_id", "store_name",
        "channel", "order_status", "subtotal", "discount_amount", "gst_amount", "total_amount", "net_amount", "has_return",
        F.coalesce("segment_name", F.lit(NO_SEGMENT)).alias("customer_segment"))


@shared
def monthly_orders(m: Retail) -> DataFrame:
    """Order measures by month; active customers are counted from (month, customer)."""
    done = F.col("order_status") == "COMPLETED"
    per_customer = orders_with_calendar(m).groupBy(F.col("order_month").alias("month"), "customer_id").agg(
        F.count_if(done).alias("n"), F.count_if(F.col("order_status") == "CANCELLED").alias("c"),
        F.sum(F.when(done, F.col("total_amount"))).alias("sales"), F.count_if(done & (F.col("channel") == "ONLINE")).alias("web"))
    return per_customer.groupBy("month").agg(
        F.sum("n").alias("orders"), F.sum("c").alias("cancelled_orders"), F.count_if(F.col("n") > 0).alias("active_customers"),
        F.sum("sales").alias("sales"), F.sum("web").alias("online_orders"))


@shared
def monthly_lines(m: Retail) -> DataFrame:
    """Line measures by month of the order."""
    return sold_lines(m).groupBy(F.col("order_month").alias("month")).agg(
        F.sum("quantity").alias("units_sold"), F.sum("net_revenue").alias("net"), F.sum("cogs").alias("cost"),
        F.sum("gross_profit").alias("profit"), F.sum("discount_amount").alias("disc"))


def monthly_sales(m: Retail) -> DataFrame:
    """Dense months. Orders of every status are read once; distinct buyers are counted from (month, customer)."""
    first, last = first_day(m), asof_day(m)
    months = (m.dim_date.filter(F.col("date_key").between(F.trunc(first, "month"), last))
              .select("year_month", F.trunc("date_key", "month").alias("month")).distinct())
    by_month, lines = monthly_orders(m), monthly_lines(m)
    refunds = (returned_lines(m).join(m.keyed("returns").select("return_id", "return_date"), "return_id")
               .groupBy(month_of("return_date").alias("month")).agg(F.sum("refund_net").alias("refunded")))

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    return (months.join(by_month, "month", "left").join(lines, "month", "left").join(refunds, "month", "left").select(
        "month", F.year("month").alias("year"), F.month("month").alias("month_number"), "year_month",
        zero("orders").alias("orders"), zero("cancelled_orders").alias("cancelled_orders"),
        zero("active_customers").alias("active_customers"), zero("units_sold").alias("units_sold"),
        rnd(zero("sales")).alias("gross_sales_incl_gst"), rnd(zero("net")).alias("net_revenue"), rnd(zero("cost")).alias("cogs"),
        rnd(zero("profit")).alias("gross_profit"), pct("profit", "net", 2).alias("gross_margin_pct"),
        rnd(ratio("sales", "orders")).alias("avg_order_value"), rnd(zero("disc")).alias("discounts"),
        rnd(zero("refunded")).alias("refunded_net"), zero("online_orders").alias("online_orders")))


@shared
def product_orders(m: Retail) -> DataFrame:
    """Sold lines summed by product and order. Behind a sort-merge join the lines already lie by order, so this grouping needs no shuffle of its own."""
    return sold_lines(m).groupBy("product_id", "order_id").agg(
        *[F.sum(c).alias(c) for c in ("quantity", "net_revenue", "gross_profit", "cogs", "discount_amount")],
        *[F.min(c).alias(c) for c in ("order_day", "store_id", "customer_id")])


def with_stored_sales(m: Retail) -> Retail:
    """The model whose datasets read sales by product and order from one stored table, instead of each meeting lines with orders on its own."""
    sales = stored_columns(product_orders(m).drop("gross_profit")).withColumns({
        "gross_profit": F.col("net_revenue") - as_double("cogs"), "order_month": F.trunc("order_day", "month"), "order_year": F.year("order_day")})
    return m.with_plans(sold_lines=sales, product_orders=sales)


@shared
def product_sales(m: Retail) -> DataFrame:
    """One row per sold product; orders are counted from (product, order)."""
    last = asof_day(m)
    recent, year = within(F.col("order_day"), last, 90), within(F.col("order_day"), last, 365)
    return product_orders(m).groupBy("product_id").agg(
        F.count("*").alias("orders"), F.sum("quantity").alias("units_sold"), F.sum("net_revenue").alias("net_revenue"),
        F.sum("gross_profit").alias("gross_profit"), F.min("order_day").alias("first_sale_date"), F.max("order_day").alias("last_sale_date"),
        F.sum(F.when(recent, F.col("quantity"))).alias("units_90d"), F.sum(F.when(year, F.col("net_revenue"))).alias("revenue_12m"),
        F.sum(F.when(year, F.col("cogs"))).alias("cogs_12m"))


def product_facts(m: Retail) -> DataFrame:
    """Every product with its sales, returns and stock, as numbers only."""
    stock = stock_value(m).groupBy("product_id").agg(F.sum("quantity_on_hand").alias("units_in_stock"),
                                                     F.sum("value").alias("inventory_value"))
    base = (m.products.select("product_id").join(product_sales(m), "product_id", "left").join(units_returned(m), "product_id", "left")
            .join(stock, "product_id", "left"))
    return base.select("product_id", "first_sale_date", "last_sale_date", *[F.coalesce(c, F.lit(0)).alias(c) for c in (
        "orders", "units_sold", "net_revenue", "gross_profit", "units_90d", "revenue_12m", "cogs_12m", "units_returned",
        "units_in_stock", "inventory_value")])


@shared
def product_net(m: Retail) -> DataFrame:
    return sold_lines(m).groupBy("product_id").agg(F.sum("net_revenue").alias("net"))


def product_classes(m: Retail) -> DataFrame:
    """Every product with its category, revenue and ABC class only: the part of the product dataset that measures need."""
    every = m.products.select("product_id").join(product_net(m), "product_id", "left").select("product_id", F.coalesce("net", F.lit(0.0)).alias("net"))
    names = canonical_products(m).select("product_id", "product_name", F.coalesce("canonical_name", F.lit(NO_CATEGORY)).alias("category"))
    return abc_classes(every, "net", "product_id").join(names, "product_id").select(
        "product_id", "product_name", "category", rnd("net").alias("net_revenue"),
        F.when(F.col("net") == 0, "No sales").otherwise(F.col("abc_class")).alias("abc_class"))


def product_performance(m: Retail) -> DataFrame:
    """The facts are placed once and feed both orderings, which move two columns each. Equal revenues share the place of
    their first row, so the rank needs no ordering of its own."""
    facts = cut_lineage(product_facts(m)).withColumn("stocked", F.col("units_in_stock") > 0)
    tiers = quantile_buckets(facts.select("product_id", "revenue_12m", "stocked"), 5,
                             [F.col("revenue_12m").asc(), F.col("product_id").asc()], "quintile", ["stocked"])
    classes = abc_classes(facts.select("product_id", "net_revenue"), "net_revenue", "product_id").drop("total_value", "row_count")
    ranks = classes.groupBy("net_revenue").agg(F.min("row_no").alias("revenue_rank"))
    placed = classes.join(ranks, "net_revenue").drop("net_revenue", "row_no")
    named = canonical_products(m).join(m.suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left").select(
        "product_id", "sku", "product_name", F.coalesce("brand", F.lit(NO_BRAND)).alias("brand"),
        F.coalesce("canonical_name", F.lit(NO_CATEGORY)).alias("category"),
        F.coalesce("supplier_name", F.lit(NO_SUPPLIER)).alias("supplier"), "is_active", "unit_price", "unit_cost", "launch_date")
    scored = (named.join(facts, "product_id").join(tiers.select("product_id", "quintile"), "product_id").join(placed, "product_id"))
    return scored.select(
        "product_id", "sku", "product_name", "brand", "category", "supplier", "is_active", "unit_price", "unit_cost",
        "launch_date", "orders", "units_sold", rnd("net_revenue").alias("net_revenue"), rnd("gross_profit").alias("gross_profit"),
        pct("gross_profit", "net_revenue", 2).alias("margin_pct"), "units_returned",
        pct("units_returned", "units_sold", 2).alias("return_rate_pct"), "first_sale_date", "last_sale_date", "units_90d",
        rnd(as_double("units_90d") / 90, 3).alias("sales_velocity_per_day"), "units_in_stock",
        rnd("inventory_value").alias("inventory_value"), rnd(cover_days("units_in_stock", "units_90d"), 1).alias("days_of_cover"),
        rnd(ratio("cogs_12m", "inventory_value")).alias("inventory_turnover_12m"), "revenue_rank",
        rnd("share_pct", 3).alias("revenue_share_pct"), rnd("cumulative_pct").alias("cumulative_revenue_pct"),
        F.when(F.col("net_revenue") == 0, "No sales").otherwise(F.col("abc_class")).alias("abc_class"),
        F.when(F.col("stocked"), stock_class(F.col("quintile"), F.col("units_90d"), F.col("units_in_stock"))).alias("product_class"))


@shared
def buyer_totals(m: Retail) -> DataFrame:
    return completed(m).groupBy("customer_id").agg(
        F.count("*").alias("orders"), F.sum("net_amount").alias("net_revenue"), F.sum("total_amount").alias("gross_sales"),
        F.min("order_day").alias("first_order_date"), F.max("order_day").alias("last_order_date"))


@shared
def customer_profit(m: Retail) -> DataFrame:
    return sold_lines(m).groupBy("customer_id").agg(F.sum("gross_profit").alias("gross_profit"))


@shared
def buyers(m: Retail) -> DataFrame:
    """One row per customer with a completed order."""
    days = F.datediff(asof_day(m), F.col("last_order_date"))
    return buyer_totals(m).withColumn("recency_days", days).withColumns({
        "avg_order_value": ratio("gross_sales", "orders"),
        "r_score": recency_score(F.col("recency_days")), "f_score": frequency_score(F.col("orders"))})


def customer_summary(m: Retail) -> DataFrame:
    return _summarised(m, quantile_buckets(buyers(m), 5, [F.col("net_revenue").asc(), F.col("customer_id").asc()], "m_score"))


def customer_values(m: Retail) -> DataFrame:
    """The customer summary without the score that needs an ordering of all buyers."""
    return _summarised(m, buyers(m))


def _summarised(m: Retail, scored: DataFrame) -> DataFrame:
    base = (m.customers.join(segment_names(m), "segment_id", "left").join(scored, "customer_id", "left")
            .join(customer_profit(m), "customer_id", "left"))
    days = F.col("recency_days")
    active, idle, lost, never = ACTIVITY_LABELS
    return base.select(
        "customer_id", title_name("first_name", "last_name").alias("customer_name"), "email", "city", "state",
        F.coalesce("segment_name", F.lit(NO_SEGMENT)).alias("segment"), "registration_date", "is_active",
        F.coalesce("orders", F.lit(0)).alias("orders"), rnd(F.coalesce("net_revenue", F.lit(0))).alias("net_revenue"),
        rnd(F.coalesce("gross_profit", F.lit(0.0))).alias("gross_profit"), rnd("avg_order_value").alias("avg_order_value"),
        "first_order_date", "last_order_date", F.trunc("first_order_date", "month").alias("cohort_month"), "recency_days",
        "r_score", "f_score", *[c for c in ("m_score",) if c in scored.columns], (F.coalesce("orders", F.lit(0)) >= 2).alias("is_repeat_customer"),
        F.datediff("last_order_date", "first_order_date").alias("active_span_days"),
        F.when(F.col("orders").isNull(), never).when(days <= 90, active).when(days <= 365, idle).otherwise(lost).alias("activity_status"),
        F.when(F.col("orders").isNotNull(), rfm_label(F.col("r_score"), F.col("f_score"))).alias("rfm_segment"))


def stock_health(m: Retail) -> DataFrame:
    """Stock positions with demand, cover and health, without the store's name."""
    last = asof_day(m)
    products = canonical_products(m).join(m.suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left").select(
        "product_id", "product_name", F.coalesce("canonical_name", F.lit(NO_CATEGORY)).alias("category"),
        F.coalesce("supplier_name", F.lit(NO_SUPPLIER)).alias("supplier"))
    base = positions(m).join(open_inbound(m), ["store_id", "product_id"], "left").join(products, "product_id")
    sold, inbound = F.coalesce("units_90d", F.lit(0)), F.coalesce("inbound_qty", F.lit(0))
    on_hand = F.col("quantity_on_hand")
    return base.select(
        "inventory_id", "store_id", "product_id", "product_name", "category", "supplier", "quantity_on_hand",
        "reserved_quantity", (on_hand - F.col("reserved_quantity")).alias("available_quantity"), "reorder_level",
        "max_stock_level", "unit_cost", rnd("value").alias("inventory_value"), sold.alias("units_sold_90d"),
        F.coalesce("units_365d", F.lit(0)).alias("units_sold_365d"), rnd(as_double(sold) / 90, 3).alias("avg_daily_demand"),
        rnd(cover_days(on_hand, sold), 1).alias("days_of_cover"), "last_restocked_date",
        F.datediff(last, F.col("last_restocked_date")).alias("days_since_restock"), inbound.alias("inbound_quantity"),
        F.greatest(F.col("max_stock_level") - on_hand - inbound, F.lit(0)).alias("suggested_order_qty"),
        F.col("status").alias("health_status"))


def inventory_health(m: Retail) -> DataFrame:
    health = stock_health(m)
    named = health.join(m.stores.select("store_id", "store_name"), "store_id")
    return named.select("inventory_id", "store_id", "store_name", *[c for c in health.columns if c not in ("inventory_id", "store_id")])


def months_open(opened: Column, start: Column, end: Column) -> Column:
    return F.greatest(as_double(F.datediff(end, F.greatest(opened, start))) / 30.44, F.lit(1.0))


def store_orders(m: Retail, year: int = 2025, before: int = 2024) -> DataFrame:
    """Order measures by store; buyers are counted from (store, customer)."""
    flagged = flag_returns(m, completed(m))
    per_customer = flagged.groupBy("store_id", "customer_id").agg(
        F.count("*").alias("n"), F.sum("net_amount").alias("net"), F.sum("total_amount").alias("gross"),
        F.sum(F.when(F.col("order_year") == before, F.col("net_amount"))).alias("old"),
        F.sum(F.when(F.col("order_year") == year, F.col("net_amount"))).alias("new"), F.count_if("has_return").alias("back"))
    return per_customer.groupBy("store_id").agg(
        F.sum("n").alias("orders"), F.count("*").alias("customers"), F.count_if(F.col("n") >= 2).alias("repeat_customers"),
        F.sum("net").alias("net_revenue"), F.sum("gross").alias("gross"), F.sum("old").alias("revenue_before"),
        F.sum("new").alias("revenue_now"), F.sum("back").alias("returned_orders"))


def store_performance(m: Retail, year: int = 2025, before: int = 2024) -> DataFrame:
    start, end = first_day(m), asof_day(m)
    units = sold_lines(m).groupBy("store_id").agg(F.sum("quantity").alias("units"), F.sum("gross_profit").alias("gross_profit"))
    stock = stock_value(m).groupBy("store_id").agg(F.sum("value").alias("inventory_value"))
    calc = (m.stores.join(store_orders(m, year, before), "store_id").join(units, "store_id").join(stock, "store_id")
            .withColumn("open_months", months_open(F.col("opened_date"), start, end))
            .withColumn("per_month", as_double("net_revenue") / F.col("open_months")))
    everywhere = Window.partitionBy()
    peers = F.avg(F.when(F.col("store_type") == "STORE", F.col("per_month"))).over(everywhere)
    return calc.select(
        "store_id", "store_code", "store_name", "store_type", "city", "state", "region", "opened_date", "orders", "units",
        "customers", rnd("net_revenue").alias("net_revenue"), rnd("gross_profit").alias("gross_profit"),
        rnd(ratio("gross", "orders")).alias("avg_order_value"),
        pct("repeat_customers", "customers", 2).alias("repeat_customer_rate_pct"),
        pct("returned_orders", "orders", 2).alias("return_rate_pct"), rnd("inventory_value").alias("inventory_value"),
        rnd("open_months", 1).alias("months_open"), rnd("per_month").alias("revenue_per_month"),
        pct("per_month", peers, 1).alias("revenue_per_month_index_vs_stores"),
        F.when(F.col("opened_date") < F.make_date(F.lit(before), F.lit(1), F.lit(1)),
               growth_pct("revenue_now", "revenue_before", 2)).alias(f"growth_{year}_vs_{before}_pct"),
        F.rank().over(everywhere.orderBy(F.col("net_revenue").desc())).alias("revenue_rank"),
        pct("net_revenue", F.sum("net_revenue").over(everywhere), 2).alias("revenue_share_pct"))


def category_performance(m: Retail) -> DataFrame:
    """Orders are a distinct count, which is pruned with its shuffle by order where only the sums are read."""
    keys = ["category_id", "order_year"]
    names = canonical_products(m).select("product_id", F.coalesce("canonical_id", F.lit(0)).alias("category_id"),
                                         F.coalesce("canonical_name", F.lit(NO_CATEGORY)).alias("category_name"))
    sold = sold_lines(m).join(names, "product_id").groupBy(*keys, "category_name").agg(
        F.sum("quantity").alias("units_sold"), F.sum("net_revenue").alias("net"), F.sum("gross_profit").alias("profit"),
        F.count_distinct("order_id").alias("orders"))
    back = (returned_lines(m).groupBy(F.col("line_order_id").alias("order_id"), "product_id").agg(F.sum("units_returned").alias("u"))
            .join(completed(m).select("order_id", "order_year"), "order_id").groupBy("product_id", "order_year").agg(F.sum("u").alias("u"))
            .join(names.select("product_id", "category_id"), "product_id").groupBy(*keys).agg(F.sum("u").alias("units_returned")))
    joined = sold.join(back, keys, "left")
    before = previous("net", "order_year", by=["category_id"])
    return joined.select(
        "category_id", "category_name", F.col("order_year").alias("year"), "orders", "units_sold", rnd("net").alias("net_revenue"),
        rnd("profit").alias("gross_profit"), pct("profit", "net", 2).alias("margin_pct"),
        F.coalesce("units_returned", F.lit(0)).alias("units_returned"),
        pct(F.coalesce("units_returned", F.lit(0)), "units_sold", 2).alias("unit_return_rate_pct"),
        growth_pct("net", before, 2).alias("yoy_growth_pct"),
        pct("net", F.sum("net").over(Window.partitionBy("order_year")), 2).alias("share_of_year_revenue_pct"))


@shared
def supplier_orders(m: Retail) -> DataFrame:
    last = asof_day(m)
    got, waiting = F.col("status") == "RECEIVED", F.col("status") == "ORDERED"
    return m.purchases.groupBy("supplier_id").agg(
        F.count("*").alias("total_pos"), F.count_if(got).alias("received_pos"),
        F.count_if(got & (F.col("received_date") <= F.col("expected_date"))).alias("on_time_pos"),
        F.avg(F.when(got, F.datediff("received_date", "expected_date"))).alias("avg_delay"),
        F.max(F.when(got, F.datediff("received_date", "expected_date"))).alias("worst_delay"),
        F.avg(F.when(got, F.datediff("received_date", "order_date"))).alias("lead_days"),
        F.count_if(waiting).alias("open_pos"), F.count_if(waiting & (F.col("expected_date") < last)).alias("overdue_pos"),
        F.sum("total_amount").alias("spend"))


@shared
def supplier_fill(m: Retail) -> DataFrame:
    got = m.purchases.filter(F.col("status") == "RECEIVED").select("purchase_id", "supplier_id")
    return m.purchase_items.join(got, "purchase_id").groupBy("supplier_id").agg(
        F.sum("quantity_ordered").alias("ordered"), F.sum("quantity_received").alias("received"),
        F.count_if(F.col("quantity_received") < F.col("quantity_ordered")).alias("short_lines"))


def supplier_performance(m: Retail) -> DataFrame:
    revenue = sold_lines(m).groupBy("product_id").agg(F.sum("net_revenue").alias("net"))
    products = (m.products.filter(F.col("supplier_id").isNotNull()).select("product_id", "supplier_id")
                .join(revenue, "product_id", "left").groupBy("supplier_id")
                .agg(F.count("*").alias("products"), F.sum(F.round("net", 2)).alias("net")))
    s = (m.suppliers.join(supplier_orders(m), "supplier_id", "left").join(supplier_fill(m), "supplier_id", "left")
         .join(products, "supplier_id", "left"))

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    return s.select(
        "supplier_id", "supplier_name", "city", "state", "is_active", F.col("lead_time_days").alias("promised_lead_days"),
        zero("products").alias("products"), rnd(zero("net")).alias("net_revenue_of_products"),
        zero("total_pos").alias("total_pos"), zero("received_pos").alias("received_pos"),
        rnd(zero("spend")).alias("purchase_spend"), pct("on_time_pos", "received_pos", 2).alias("on_time_pct"),
        rnd("avg_delay").alias("avg_days_vs_expected"), rnd("lead_days").alias("actual_lead_days"),
        rnd(F.col("lead_days") - F.col("lead_time_days")).alias("lead_time_gap_days"),
        pct("received", "ordered", 2).alias("fill_rate_pct"), zero("open_pos").alias("open_pos"),
        zero("overdue_pos").alias("overdue_pos"),
        (F.col("contact_email").isNull() | F.col("contact_phone").isNull() | F.col("gstin").isNull()).alias("missing_contact_info"))


def returned_sales(m: Retail, buyers: DataFrame | None = None) -> DataFrame:
    """Returned lines with their return and their sale, without any dimension; attributes of `buyers` meet the sale, which is narrower and shuffled anyway.
    The return meets its sale first, so that the lines' amounts are not shuffled by order too."""
    header = m.keyed("returns").select("return_id", "order_id", "return_date", "return_reason")
    sale = orders_with_calendar(m).select("order_id", "order_date", "order_day", "customer_id", "store_id", "channel")
    sale = sale if buyers is None else sale.join(buyers, "customer_id")
    return _rounded(returned_lines(m).join(header.join(sale, "order_id"), "return_id").withColumns({
        "return_day": day_of("return_date"), "return_month": month_of("return_date")}))


def return_analysis(m: Retail) -> DataFrame:
    products = canonical_products(m).select("product_id", "product_name", "canonical_name")
    customers = m.customers.select("customer_id", "segment_id").join(segment_names(m), "segment_id", "left")
    base = returned_sales(m, customers).join(products, "product_id").join(m.stores.select("store_id", "store_name"), "store_id")
    return base.select(
        "return_item_id", "return_id", "return_date", "return_day", "return_month", "order_id", "order_date", "order_day",
        rnd(elapsed_days("order_date", "return_date"), 1).alias("days_to_return"), "return_reason", "store_id", "store_name",
        "channel", F.coalesce("segment_name", F.lit(NO_SEGMENT)).alias("customer_segment"), "product_id", "product_name",
        F.coalesce("canonical_name", F.lit(NO_CATEGORY)).alias("category"), "units_returned", "units_in_line", "refund_amount",
        "refund_net_of_gst", "cost_value", "restocked")


def elapsed_days(start: str, end: str) -> Column:
    """Days between two timestamps with their fraction, to the second."""
    return F.timestamp_diff("SECOND", F.col(start), F.col(end)) / 86400.0


DATASETS = {
    "vw_asof": (asof, "Data window: first order day and as-of day."),
    "vw_category_canonical": (category_canonical, "Category lookup with case variants merged."),
    "vw_sales_lines": (sales_lines, "One row per sold order line (completed orders)."),
    "vw_orders": (orders, "One row per order, all statuses."),
    "vw_monthly_sales": (monthly_sales, "Monthly KPIs, one row per calendar month of the window."),
    "vw_product_performance": (product_performance, "Product scorecard with ABC and stock class."),
    "vw_customer_summary": (customer_summary, "Customer value, RFM scores and activity."),
    "vw_inventory_health": (inventory_health, "Stock positions with demand, cover and health."),
    "vw_store_performance": (store_performance, "Store scorecard."),
    "vw_category_performance": (category_performance, "Category by year."),
    "vw_supplier_performance": (supplier_performance, "Supplier scorecard."),
    "vw_return_analysis": (return_analysis, "One row per returned order line."),
}


def dataset(m: Retail, name: str, **options) -> DataFrame:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}")
    return DATASETS[name][0](m, **options)
