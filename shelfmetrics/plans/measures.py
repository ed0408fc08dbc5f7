"""The measure layer: measures evaluated in a filter context over the star of facts and dimensions.

``measures(m, names, group_by, filters)`` aggregates every fact the measures need at its own grain, by the attributes
that reach it, and joins the small results. An attribute that does not reach a fact neither filters nor splits it: stock
and lifetime measures ignore dates, order measures ignore products, and their value repeats over the groups.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ratio
from ..operators import Grouping, KeyBits, key_bits, stored_columns, sums_together, whole
from ..sources import Retail
from ..sources.layout import order_key, since
from . import datasets as d

# The attributes that reach each fact (fixed by the star schema).
DATES, PLACE, GOODS, PEOPLE = ["year", "month"], ["region", "store_name"], ["category", "product_name"], ["segment"]
REACH = {
    "lines": DATES + PLACE + GOODS + PEOPLE + ["channel"],
    "orders": DATES + PLACE + PEOPLE + ["channel"],
    "buyers": DATES + PLACE + PEOPLE + ["channel"],
    "returns": DATES + PLACE + GOODS + ["channel", "return_segment"],
    "returns_by_return_day": DATES + PLACE + GOODS + ["channel", "return_segment"],
    "lines_12m": PLACE + GOODS + PEOPLE + ["channel"],
    "stock": PLACE + GOODS + ["health_status"],
    "customers": PEOPLE + ["rfm_segment"],
    "new_customers": DATES + PEOPLE + ["rfm_segment"],
    "products": GOODS,
    "calendar": DATES,
}
TIME_MEASURES = ["net_revenue_py", "net_revenue_yoy_pct", "net_revenue_pm", "net_revenue_mom_pct", "net_revenue_3m_avg", "net_revenue_running_total"]


@dataclass(frozen=True)
class Base:
    """An aggregate of one fact; ``column`` is set where it is the sum of that column."""
    fact: str
    value: Callable[[], Column]
    column: str | None = None


@dataclass(frozen=True)
class Derived:
    """An expression over other measures."""
    needs: tuple[str, ...]
    value: Callable[[], Column]


def _sum(fact: str, column: str, where: Callable[[], Column] | None = None) -> Base:
    return Base(fact, lambda: F.sum(column) if where is None else F.sum(F.when(where(), F.col(column))), column if where is None else None)


def _count(fact: str, where: Callable[[], Column] | None = None) -> Base:
    return Base(fact, lambda: F.count("*") if where is None else F.count_if(where()))


def _ratio(a: str, b: str) -> Derived:
    return Derived((a, b), lambda: ratio(a, b))


def _is(column: str, value: str) -> Callable[[], Column]:
    return lambda: F.col(column) == value


def _done() -> Column:
    return F.col("order_status") == "COMPLETED"


MEASURES: dict[str, Base | Derived] = {
    "net_revenue": _sum("lines", "net_revenue"),
    "gross_profit": _sum("lines", "gross_profit"),
    "cogs": _sum("lines", "cogs"),
    "gross_margin_pct": _ratio("gross_profit", "net_revenue"),
    "units_sold": _sum("lines", "quantity"),
    "discount_given": _sum("lines", "discount_amount"),
    "orders_line_basis": Base("lines", lambda: F.count_distinct("order_id")),
    "completed_orders": _count("orders", _done),
    "cancelled_orders": _count("orders", _is("order_status", "CANCELLED")),
    "all_orders": _count("orders"),
    "cancellation_rate": _ratio("cancelled_orders", "all_orders"),
    "order_sales_incl_gst": _sum("orders", "total_amount", _done),
    "average_order_value": _ratio("order_sales_incl_gst", "completed_orders"),
    "total_customers": Base("buyers", lambda: F.count_distinct(F.when(_done(), F.col("customer_id")))),
    "purchase_frequency": _ratio("completed_orders", "total_customers"),
    "online_orders": _count("orders", lambda: _done() & (F.col("channel") == "ONLINE")),
    "online_order_share": _ratio("online_orders", "completed_orders"),
    "buying_customers": _count("customers", lambda: F.col("orders") > 0),
    "repeat_customers": _count("customers", lambda: F.col("is_repeat_customer")),
    "repeat_customer_rate": _ratio("repeat_customers", "buying_customers"),
    "lifetime_revenue": _sum("customers", "net_revenue"),
    "avg_customer_lifetime_revenue": _ratio("lifetime_revenue", "buying_customers"),
    "active_customers_90d": _count("customers", _is("activity_status", d.ACTIVITY_LABELS[0])),
    "new_customers": _count("new_customers", lambda: F.col("cohort_month").isNotNull()),
    "returning_customers": Derived(("total_customers", "new_customers"), lambda: F.greatest(
        F.coalesce("total_customers", F.lit(0)) - F.coalesce("new_customers", F.lit(0)), F.lit(0))),
    "orders_with_returns": _count("orders", lambda: _done() & F.col("has_return")),
    "order_return_rate": _ratio("orders_with_returns", "completed_orders"),
    "units_returned": _sum("returns", "units_returned"),
    "unit_return_rate": _ratio("units_returned", "units_sold"),
    "refunded_net_of_gst": _sum("returns", "refund_net_of_gst"),
    "refund_pct_of_net_revenue": _ratio("refunded_net_of_gst", "net_revenue"),
    "refunded_net_of_gst_by_return_date": _sum("returns_by_return_day", "refund_net_of_gst"),
    "write_off_cost": _sum("returns", "cost_value", lambda: ~F.col("restocked")),
    "inventory_value": _sum("stock", "inventory_value"),
    "units_on_hand": _sum("stock", "quantity_on_hand"),
    "stock_positions": _count("stock"),
    "out_of_stock_positions": _count("stock", _is("health_status", "OUT_OF_STOCK")),
    "low_stock_positions": _count("stock", _is("health_status", "LOW_STOCK")),
    "healthy_positions": _count("stock", _is("health_status", "HEALTHY")),
    "overstocked_positions": _count("stock", _is("health_status", "OVERSTOCKED")),
    "dead_stock_positions": _count("stock", _is("health_status", "DEAD_STOCK")),
    "overstock_value": _sum("stock", "inventory_value", _is("health_status", "OVERSTOCKED")),
    "dead_stock_value": _sum("stock", "inventory_value", _is("health_status", "DEAD_STOCK")),
    "surplus_share_of_value": Derived(("overstock_value", "dead_stock_value", "inventory_value"), lambda: ratio(
        F.coalesce("overstock_value", F.lit(0)) + F.coalesce("dead_stock_value", F.lit(0)), "inventory_value")),
    "stock_out_risk_pct": Derived(("out_of_stock_positions", "low_stock_positions", "stock_positions"), lambda: ratio(
        F.col("out_of_stock_positions") + F.col("low_stock_positions"), "stock_positions")),
    "suggested_order_qty": _sum("stock", "suggested_order_qty", lambda: F.col("health_status").isin("OUT_OF_STOCK", "LOW_STOCK")),
    "cogs_last_12m": _sum("lines_12m", "cogs_12m"),
    "cogs_last_365d": _sum("lines_12m", "cogs_365d"),
    "inventory_turnover": _ratio("cogs_last_12m", "inventory_value"),
    "days_of_inventory": Derived(("inventory_turnover",), lambda: F.lit(365.0) / F.nullif("inventory_turnover", F.lit(0.0))),
    "class_a_products": _count("products", _is("abc_class", "A")),
    "class_a_revenue": _sum("products", "net_revenue", _is("abc_class", "A")),
    "product_revenue": _sum("products", "net_revenue"),
    "class_a_revenue_share": _ratio("class_a_revenue", "product_revenue"),
    "period_first": Base("calendar", lambda: F.min("day")),
    "period_last": Base("calendar", lambda: F.max("day")),
    "period_label": Derived(("period_first", "period_last"), lambda: F.concat(
        F.date_format("period_first", "d MMM yyyy"), F.lit(" to "), F.date_format("period_last", "d MMM yyyy"))),
}

PLAIN_STOCK = {"inventory_value", "units_on_hand", "stock_positions"}  # measures of stock that need no demand


def _dated(df: DataFrame, day: str) -> DataFrame:
    return df.withColumns({"year": F.year(day), "month": F.trunc(day, "month")})


def _goods(m: Retail) -> DataFrame:
    return d.canonical_products(m).select("product_id", "product_name", F.coalesce("canonical_name", F.lit(d.NO_CATEGORY)).alias("category"))


def _reached(m: Retail, df: DataFrame, used: set[str], segment: str = "segment") -> DataFrame:
    """The dimensions of the attributes that are used, and no others."""
    if used & set(GOODS):
        df = df.join(_goods(m), "product_id")
    if used & set(PLACE):
        df = df.join(m.stores.select("store_id", "region", "store_name"), "store_id")
    if segment in used:
        df = df.join(_segments(m).withColumnRenamed("segment", segment), "customer_id")
    return df


def fact(m: Retail, name: str, used: set[str], summary: DataFrame | None = None, by_order: bool = False) -> DataFrame:
    """A fact with the attributes that are used. The customer summary is passed in, as two facts read it; lines whose orders are counted meet goods first."""
    used = used & set(REACH[name])
    if name in ("lines", "lines_12m"):
        early = by_order and bool(used & set(GOODS))
        df = _reached(m, d.sold_lines_of(m, _goods(m)) if early else d.sold_lines(m), used - set(GOODS) if early else used)
        if name == "lines_12m":
            return _trailing(m, since(df, _year_start(m), "order_day"))
        return _dated(df, "order_day")
    if name in ("orders", "buyers"):
        every = d.orders_with_calendar(m)
        return _dated(_reached(m, d.flag_returns(m, every) if name == "orders" else every, used), "order_day")
    if name in ("returns", "returns_by_return_day"):
        if "returned_lines_of_sales" in m.given and not used - set(GOODS):
            return _reached(m, m.given["returned_lines_of_sales"], used)
        day = "order_day" if name == "returns" else "return_day"
        return _dated(_reached(m, d.returned_sales(m), used, "return_segment"), day)
    if name == "stock":
        return _reached(m, d.stock_health(m), used - set(GOODS))
    if name == "customers":
        return summary
    if name == "new_customers":
        return _dated(summary.filter(F.col("cohort_month").isNotNull()), "cohort_month")
    if name == "products":
        return d.product_classes(m)
    if name == "calendar":
        days = m.dim_date.select(F.col("date_key").alias("day")).filter(F.col("day").between(d.first_day(m), d.asof_day(m)))
        return _dated(days, "day")
    raise KeyError(name)


def _year_start(m: Retail) -> Column:
    """The first of the last twelve months' days; the last 365 days lie inside them."""
    return F.date_add(F.add_months(d.asof_day(m), -12), 1)


def _trailing(m: Retail, lines: DataFrame) -> DataFrame:
    day = F.col("order_day")
    return lines.withColumns({"cogs_12m": F.when(day >= _year_start(m), F.col("cogs")), "cogs_365d": F.when(day >= F.date_add(d.asof_day(m), -364), F.col("cogs"))})


def _share_facts(by_fact: dict[str, list[str]], used: set[str]) -> None:
    """Without dates among the groups and filters, trailing lines are lines, new customers are customers, and returns by either day are the same rows: one
    fact serves both. Buyers are counted with the orders, unless these have to meet their returns: then the customers would be shuffled with all order sums."""
    if {"orders", "buyers"} <= set(by_fact) and "orders_with_returns" not in by_fact["orders"]:
        by_fact["orders"] += by_fact.pop("buyers")
    if used & set(DATES):
        return
    for name, wider in (("lines_12m", "lines"), ("new_customers", "customers"), ("returns_by_return_day", "returns")):
        if {name, wider} <= set(by_fact):
            by_fact[wider] += by_fact.pop(name)


def _sales_together(m: Retail, by_fact: dict[str, list[str]], keys: list[str]) -> tuple[Retail, DataFrame | None]:
    """Lines meet their orders once for all facts that sum sales: the groups of lines, the net revenue of products and the demand of stock positions. Returned are the
    model that has the latter two, and the sums of the groups. Only goods among the groups, and no filter: each fact then sums the same lines."""
    graded, judged = "products" in by_fact, bool(set(by_fact.get("stock", [])) - PLAIN_STOCK)
    if "lines" not in by_fact or not graded and not judged or not set(keys) <= set(GOODS):
        return m, None
    wanted, last = by_fact["lines"], d.asof_day(m)
    returned = bool({"returns", "returns_by_return_day"} & set(by_fact))
    bits = _order_bits(m, returned)
    if bits is not None:
        return _sales_by_bits(m, bits, wanted, keys, graded, judged, returned, "suggested_order_qty" in by_fact.get("stock", []))
    rows = _trailing(m, d.sold_lines_of(m, _goods(m)) if keys else d.sold_lines(m))
    # Lines lie by order here, so the first of an order (and group) is marked without a shuffle.
    first = F.count("*").over(Window.partitionBy("order_id", *keys).rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = rows.withColumn("_first", first.cast("int")) if "orders_line_basis" in wanted else rows
    groupings = [Grouping(keys, {n: F.col(MEASURES[n].column or "_first") for n in wanted})]
    if graded:
        groupings.append(Grouping(["product_id"], {"net_revenue": F.col("net_revenue")}))
    if judged:
        groupings.append(Grouping(["store_id", "product_id"], {
            "units_90d": F.when(d.within(F.col("order_day"), last, 90), F.col("quantity")), "units_365d": F.col("quantity")},
            F.col("order_day") >= F.date_add(last, -364)))
    own, *rest = sums_together(rows, groupings)
    given = {"product_net": rest.pop(0).withColumnRenamed("net_revenue", "net")} if graded else {}
    given |= {"position_demand": rest.pop(0)} if judged else {}
    if not keys:
        own = own.agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) if n == "orders_line_basis" else F.max(n).alias(n) for n in wanted])
    return m.with_plans(**given), own


def _order_bits(m: Retail, returned: bool) -> KeyBits | None:
    """Which orders are known, completed, of the last twelve months and 365 days; None where lines and returns cannot be told by the bits of their order,
    are stored by month with it, or come with it from a stored table."""
    tables = [m.sales_order_items, *([m.keyed("returns")] if returned else [])]
    if "sold_lines" in m.given or not all(whole(t, "order_id") for t in tables) or order_key(m.sales_orders, m.sales_order_items) != ["order_id"]:
        return None
    done, day = _done(), F.col("order_day")
    return key_bits(d.orders_with_calendar(m), "order_id", {
        "completed": done, "trailing": done & (day >= _year_start(m)), "recent": done & (day >= F.date_add(d.asof_day(m), -364))})


def _sales_by_bits(m: Retail, bits: KeyBits, wanted: list[str], keys: list[str], graded: bool, judged: bool, returned: bool,
                   inbound: bool) -> tuple[Retail, DataFrame]:
    """The same by flags of the orders: a line is shuffled by its product at most, and by its order only to count orders. The sums are stored."""
    lines = d.sold_lines_flagged(m, bits, "trailing", "recent", goods=_goods(m) if keys else None).withColumns(
        {"cogs_12m": F.when(F.col("trailing"), F.col("cogs")), "cogs_365d": F.when(F.col("recent"), F.col("cogs"))})
    sums = [F.sum(MEASURES[n].column).alias(n) for n in wanted if n != "orders_line_basis"]
    own, given = [], {}
    if keys and (graded or sums):
        by_product = stored_columns(lines.groupBy("product_id", *keys).agg(F.sum("net_revenue").alias("net"), *sums))
        given["product_net"] = by_product.groupBy("product_id").agg(F.sum("net").alias("net"))
        again = [F.sum(n).cast(by_product.schema[n].dataType).alias(n) for n in wanted if n != "orders_line_basis"]
        own += [by_product.groupBy(*keys).agg(*again)] if again else []
    elif not keys:
        given["product_net"] = lines.groupBy("product_id").agg(F.sum("net_revenue").alias("net"))
        own += [lines.agg(*sums)] if sums else []
    if "orders_line_basis" in wanted:
        own.append(lines.groupBy(*keys).agg(F.count_distinct("order_id").alias("orders_line_basis")))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)
    if returned:
        given["returned_lines_of_sales"] = d.returned_lines_flagged(m, bits)
    if judged:
        given["position_demand"] = stored_columns(d.demand(m, ["store_id", "product_id"], bits=bits))
    if inbound and whole(m.purchase_items, "purchase_id"):
        opened = key_bits(m.purchases, "purchase_id", {"open": F.col("status") == "ORDERED"})
        given |= {} if opened is None else {"open_inbound": d.inbound(m, opened)}
    return m.with_plans(**given), stored_columns(table.groupBy(*keys).agg(*[F.max(n).alias(n) for n in wanted]))


def _segments(m: Retail) -> DataFrame:
    return m.customers.select("customer_id", "segment_id").join(d.segment_names(m), "segment_id", "left").select(
        "customer_id", F.coalesce("segment_name", F.lit(d.NO_SEGMENT)).alias("segment"))


def _filtered(df: DataFrame, filters: dict[str, Sequence], reach: Sequence[str]) -> DataFrame:
    for attribute, values in filters.items():
        if attribute in reach:
            df = df.filter(F.col(attribute).isin(list(values)))
    return df


def _needed(names: Sequence[str]) -> list[str]:
    """The measures and what they are derived from, dependencies first."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name not in MEASURES:
            raise KeyError(f"unknown measure {name!r}")
        if isinstance(MEASURES[name], Derived):
            for dep in MEASURES[name].needs:
                visit(dep)
        if name not in out:
            out.append(name)

    for n in names:
        visit(n)
    return out


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    return left.join(right, keys, how) if keys else left.join(right, how=how)


def measures(m: Retail, names: Sequence[str], group_by: Sequence[str] = (), filters: dict[str, Sequence] | None = None) -> DataFrame:
    """One row per group (one row without ``group_by``) with the named measures."""
    filters, keys = dict(filters or {}), list(group_by)
    known = {a for reach in REACH.values() for a in reach}
    if not set(keys) | set(filters) <= known:
        raise KeyError(f"unknown attributes: {sorted((set(keys) | set(filters)) - known)}")
    timed = [n for n in names if n in TIME_MEASURES]
    plain = _needed([n for n in names if n not in TIME_MEASURES])
    by_fact: dict[str, list[str]] = {}
    for n in plain:
        if isinstance(MEASURES[n], Base):
            by_fact.setdefault(MEASURES[n].fact, []).append(n)
    _share_facts(by_fact, set(keys) | set(filters))
    frames: list[tuple[list[str], DataFrame]] = []
    summary = d.customer_values(m) if {"customers", "new_customers"} & set(by_fact) else None
    m, sales = (m, None) if filters else _sales_together(m, by_fact, keys)
    for f, wanted in by_fact.items():
        if f == "lines" and sales is not None:
            frames.append((keys, sales))
            continue
        own = [k for k in keys if k in REACH[f]]
        rows = _filtered(fact(m, f, set(keys) | set(filters), summary, "orders_line_basis" in wanted), filters, REACH[f])
        if f == "lines" and any(MEASURES[n].fact == "lines_12m" for n in wanted):
            rows = _trailing(m, rows)
        frames.append((own, rows.groupBy(*own).agg(*[MEASURES[n].value().alias(n) for n in wanted])))
    if timed:
        frames.append((keys, time_measures(m, keys, filters).select(*keys, *timed)))
    if not keys:
        table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df for _, df in frames])
        table = table.agg(*[F.max(c).alias(c) for c in table.columns])
    else:
        full = [df for own, df in frames if own == keys]
        if not full:
            raise ValueError(f"no fact of these measures is reached by all of {keys}")
        table = reduce(lambda a, b: _same(a, b, keys, "full_outer"), full)
        for own, df in frames:
            if own != keys and own:
                table = table.join(df, own, "left")
            elif own != keys:
                table = table.select("*", *[df.select(c).scalar().alias(c) for c in df.columns])
    for n in plain:
        if isinstance(MEASURES[n], Derived):
            table = table.withColumn(n, MEASURES[n].value())
    return table.select(*keys, *names)


def time_measures(m: Retail, keys: Sequence[str], filters: dict[str, Sequence] | None = None) -> DataFrame:
    """Net revenue against earlier periods by month or year. Every group gets all months of the window, computed before
    date filters are applied, so a slicer on dates does not cut the look-back."""
    grain = next((k for k in keys if k in DATES), None)
    if grain is None:
        raise ValueError("time measures need month or year among the groups")
    filters = dict(filters or {})
    other = [k for k in keys if k not in DATES]
    reach = [a for a in REACH["lines"] if a not in DATES]
    by_month = _filtered(fact(m, "lines", set(other) | set(filters)), filters, reach).groupBy(*other, "month").agg(F.sum("net_revenue").alias("net"))
    first, last = F.trunc(d.first_day(m), "month"), F.trunc(d.asof_day(m), "month")
    spine = (by_month.select(*other).distinct() if other else m.spark.range(1).select()).select(
        *other, F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("month"))
    dense = spine.join(by_month, [*other, "month"], "left").withColumn("year", F.year("month"))
    w = Window.partitionBy(*other).orderBy("month")
    three, upto = w.rowsBetween(-2, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    rolled = dense.withColumns({"net_revenue_3m_avg": F.sum("net").over(three) / 3, "net_revenue_running_total": F.sum("net").over(upto)})
    if "month" in keys:
        rows = rolled.withColumns({"now": F.col("net"), "net_revenue_py": F.lag("net", 12).over(w), "net_revenue_pm": F.lag("net", 1).over(w)})
    else:
        per_year = rolled.groupBy(*other, "year").agg(
            F.sum("net").alias("now"), F.max_by("net_revenue_3m_avg", "month").alias("net_revenue_3m_avg"),
            F.max_by("net_revenue_running_total", "month").alias("net_revenue_running_total"), F.min("month").alias("start"))
        by_year = Window.partitionBy(*other).orderBy("year")
        before = dense.select(*other, F.add_months("month", 1).alias("start"), F.col("net").alias("net_revenue_pm"))
        rows = per_year.withColumn("net_revenue_py", F.lag("now").over(by_year)).join(before, [*other, "start"], "left")
    out = rows.withColumns({
        "net_revenue_yoy_pct": ratio(F.col("now") - F.col("net_revenue_py"), "net_revenue_py"),
        "net_revenue_mom_pct": ratio(F.col("now") - F.col("net_revenue_pm"), "net_revenue_pm")})
    return _filtered(out, filters, [k for k in DATES if k in out.columns]).select(*keys, *TIME_MEASURES)


# Names and scale of the expected values: measure -> (label, factor).
ALL_DATA = [
    ("net_revenue", "Net Revenue"), ("gross_profit", "Gross Profit"), ("cogs", "COGS"), ("gross_margin_pct", "Gross Margin %"),
    ("units_sold", "Units Sold"), ("discount_given", "Discount Given"), ("orders_line_basis", "Orders (line basis)"),
    ("completed_orders", "Completed Orders"), ("cancelled_orders", "Cancelled Orders"), ("cancellation_rate", "Cancellation Rate %"),
    ("order_sales_incl_gst", "Order Sales incl GST"), ("average_order_value", "Average Order Value"), ("total_customers", "Total Customers"),
    ("purchase_frequency", "Purchase Frequency"), ("online_order_share", "Online Order Share %"),
    ("buying_customers", "Buying Customers (lifetime)"), ("repeat_customers", "Repeat Customers"),
    ("repeat_customer_rate", "Repeat Customer Rate %"), ("avg_customer_lifetime_revenue", "Avg Customer Lifetime Revenue"),
    ("active_customers_90d", "Active Customers (90d)"), ("orders_with_returns", "Orders With Returns"),
    ("order_return_rate", "Order Return Rate %"), ("units_returned", "Units Returned"), ("unit_return_rate", "Unit Return Rate %"),
    ("refunded_net_of_gst", "Refunded Net of GST"), ("refund_pct_of_net_revenue", "Refund % of Net Revenue"),
    ("write_off_cost", "Write-off Cost"), ("inventory_value", "Inventory Value"), ("units_on_hand", "Units On Hand"),
    ("stock_positions", "Stock Positions"), ("out_of_stock_positions", "Out of Stock Positions"),
    ("low_stock_positions", "Low Stock Positions"), ("healthy_positions", "Healthy Positions"),
    ("overstocked_positions", "Overstocked Positions"), ("dead_stock_positions", "Dead Stock Positions"),
    ("overstock_value", "Overstock Value"), ("dead_stock_value", "Dead Stock Value"),
    ("surplus_share_of_value", "Surplus Share of Value %"), ("stock_out_risk_pct", "Stock-out Risk %"),
    ("suggested_order_qty", "Suggested Order Qty"), ("cogs_last_365d", "COGS Last 12M"), ("turnover_365d", "Inventory Turnover"),
    ("days_365d", "Days of Inventory"), ("class_a_products", "Class A Products"), ("class_a_revenue_share", "Class A Revenue Share %"),
]
BY_YEAR = [
    ("net_revenue", "Net Revenue"), ("gross_profit", "Gross Profit"), ("gross_margin_pct", "Gross Margin %"), ("units_sold", "Units Sold"),
    ("discount_given", "Discount Given"), ("completed_orders", "Completed Orders"), ("cancelled_orders", "Cancelled Orders"),
    ("total_customers", "Total Customers"), ("average_order_value", "Average Order Value"), ("order_return_rate", "Order Return Rate %"),
    ("net_revenue_yoy_pct", "Net Revenue YoY %"),
]


def long_form(df: DataFrame, rows: list[tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, measure, value): labels with a percent sign are scaled to 0-100."""
    def line(c: str, label: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(F.lit(label).alias("measure"), F.round(v * 100 if "%" in label else v, 2).alias("value"))
    return df.select(*keys, F.inline(F.array(*[line(c, label) for c, label in rows])))


def all_data(m: Retail) -> DataFrame:
    """Every card's value without slicers; cost of goods of the last 365 days."""
    names = [n for n, _ in ALL_DATA if not n.endswith("365d")]
    table = measures(m, [*names, "cogs_last_365d"]).withColumn("turnover_365d", ratio("cogs_last_365d", "inventory_value"))
    return long_form(table.withColumn("days_365d", F.lit(365.0) / F.nullif("turnover_365d", F.lit(0.0))), ALL_DATA)


def by_year(m: Retail) -> DataFrame:
    """The year-based measures per year: (year, measure, value)."""
    return long_form(measures(m, [n for n, _ in BY_YEAR], ["year"]), BY_YEAR, ["year"])
