"""Stock levels, health, turnover, cover and risk (Q59-Q71)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_double, band, cover_days, month_of, net_of_tax, part_of_total, pct, ratio, rnd, stacked, top
from ..operators import percent_ranks, quantile_buckets
from ..sources import Retail
from ..sources.layout import since
from .datasets import (HEALTH_STATUSES, asof_day, canonical_products, completed, demand, open_inbound, positions, sold_lines, stock_class,
                       stock_value, within)
from .registry import query

SURPLUS, SHORT = ["OVERSTOCKED", "DEAD_STOCK"], ["OUT_OF_STOCK", "LOW_STOCK"]


@query("Inventory position by store")
def q59_stock_by_store(m: Retail) -> DataFrame:
    prices = m.products.select("product_id", "unit_price", "gst_rate")
    on_hand = F.col("quantity_on_hand")
    by = stock_value(m).join(prices, "product_id").groupBy("store_id").agg(
        F.sum(on_hand).alias("units_on_hand"), F.sum("reserved_quantity").alias("units_reserved"),
        F.sum(on_hand - F.col("reserved_quantity")).alias("units_available"), F.sum("value").alias("v"),
        F.sum(on_hand * net_of_tax("unit_price", "gst_rate")).alias("p"), F.count("*").alias("stocked_products"))
    return by.join(m.stores.select("store_id", "store_name"), "store_id").select(
        "store_name", "units_on_hand", "units_reserved", "units_available", rnd("v", 0).alias("value_at_cost"),
        rnd("p", 0).alias("value_at_net_price"), "stocked_products").orderBy(F.col("value_at_cost").desc())


@query("Inventory health classification")
def q60_health_summary(m: Retail) -> DataFrame:
    by = positions(m).groupBy("status").agg(
        F.count("*").alias("store_product_positions"), F.sum("quantity_on_hand").alias("units"), F.sum("value").alias("v"))
    shared = part_of_total(part_of_total(by, "store_product_positions", "share_of_positions_pct", 1), "v", "share_of_value_pct", 1)
    place = F.array_position(F.array(*[F.lit(s) for s in HEALTH_STATUSES]), F.col("status"))
    return shared.orderBy(place).select("status", "store_product_positions", "share_of_positions_pct", "units",
                                        rnd("v", 0).alias("value_at_cost"), "share_of_value_pct")


@query("Replenishment list: sellers at or below their reorder level")
def q61_replenishment(m: Retail, n: int = 25) -> DataFrame:
    keys = ["store_id", "product_id"]
    sold = demand(m, keys, long=90).select(*keys, "units_90d")
    needy = m.inventory.filter(F.col("quantity_on_hand") <= F.col("reorder_level")).join(sold, keys)
    most = top(needy, n, F.col("units_90d").desc(), F.col("store_id"), F.col("product_id"))
    inbound = open_inbound(m).join(most.select(*keys), keys, "left_semi")
    names = most.join(m.products.select("product_id", "product_name"), "product_id").join(m.stores.select("store_id", "store_name"), "store_id")
    coming = F.coalesce("inbound_qty", F.lit(0))
    return names.join(inbound, keys, "left").orderBy(F.col("units_90d").desc(), *keys).select(
        "store_name", "product_name", "quantity_on_hand", "reorder_level", "max_stock_level",
        rnd(as_double("units_90d") / 90).alias("avg_daily_demand"), coming.alias("inbound_on_open_pos"),
        F.greatest(F.col("max_stock_level") - F.col("quantity_on_hand") - coming, F.lit(0)).alias("suggested_order_qty"))


@query("Inventory turnover and days of inventory by category")
def q62_turnover(m: Retail) -> DataFrame:
    cats = canonical_products(m).filter(F.col("canonical_id").isNotNull()).select("product_id", "canonical_id", "canonical_name")
    last = asof_day(m)
    cost = (since(sold_lines(m), F.date_add(last, -364), "order_day").groupBy("product_id").agg(F.sum("cogs").alias("c"))
            .join(cats, "product_id").groupBy("canonical_id", "canonical_name").agg(F.sum("c").alias("cogs")))
    stock = (stock_value(m).groupBy("product_id").agg(F.sum("value").alias("v")).join(cats, "product_id")
             .groupBy("canonical_id").agg(F.sum("v").alias("stock")))
    return cost.join(stock, "canonical_id").select(
        F.col("canonical_name").alias("category_name"), rnd("cogs", 0).alias("cogs_last_12m"), rnd("stock", 0).alias("inventory_value"),
        rnd(ratio("cogs", "stock")).alias("inventory_turnover"), rnd(ratio(as_double("stock") * 365, "cogs"), 0).alias("days_of_inventory")
    ).orderBy(F.col("inventory_turnover").desc())


@query("Days-of-cover bands")
def q63_cover_bands(m: Retail) -> DataFrame:
    keys = ["store_id", "product_id"]
    held = stock_value(m).join(demand(m, keys, long=90), keys)
    label = band(cover_days("quantity_on_hand", "units_90d"),
                 [(7, "a) under 7 days"), (30, "b) 7-29 days"), (90, "c) 30-89 days"), (180, "d) 90-179 days")], "e) 180+ days")
    by = held.groupBy(label.alias("stock_cover")).agg(F.count("*").alias("positions"), rnd(F.sum("value"), 0).alias("value_at_cost"))
    return part_of_total(by, "positions", "share_pct", 1).select("stock_cover", "positions", "share_pct", "value_at_cost").orderBy("stock_cover")


def stocked_products(m: Retail) -> DataFrame:
    """Products with stock: units of the last 90 days, units in stock and their value."""
    stock = stock_value(m).groupBy("product_id").agg(F.sum("quantity_on_hand").alias("units_in_stock"), F.sum("value").alias("value"))
    sold = demand(m, ["product_id"], long=90).select("product_id", F.col("units_90d").alias("u"))
    return (stock.filter(F.col("units_in_stock") > 0).join(sold, "product_id", "left")
            .withColumn("units_90d", F.coalesce("u", F.lit(0))).drop("u"))


@query("Fast, medium, slow and non-moving products")
def q64_movement_classes(m: Retail) -> DataFrame:
    moving = stocked_products(m).withColumn("moves", F.col("units_90d") > 0)
    ranked = percent_ranks(moving, "units_90d", "place", by=["moves"])
    label = (F.when(~F.col("moves"), "NON_MOVING").when(F.col("place") >= 0.75, "FAST_MOVING").when(F.col("place") <= 0.25, "SLOW_MOVING")
             .otherwise("MEDIUM"))
    by = ranked.groupBy(label.alias("movement_class")).agg(
        F.count("*").alias("products"), F.sum("units_90d").alias("units_sold_90d"), rnd(F.sum("value"), 0).alias("stock_value_at_cost"),
        F.min(F.when(F.col("moves"), F.col("place"))).alias("low"))
    return by.orderBy(F.col("low").desc_nulls_last()).drop("low")


@query("Ten fastest and ten slowest sellers with stock")
def q65_fastest_and_slowest(m: Retail, n: int = 10) -> DataFrame:
    held = stocked_products(m)
    units, stock, key = F.col("units_90d"), F.col("units_in_stock"), F.col("product_id")
    fast = top(held, n, units.desc(), key).withColumn("list", F.lit("FASTEST"))
    slow = top(held.filter(units > 0), n, units, stock.desc(), key).withColumn("list", F.lit("SLOWEST (sold at least 1)"))
    return stacked(fast, slow).join(m.products.select("product_id", "product_name"), "product_id").select(
        "list", "product_name", "units_90d", "units_in_stock").orderBy(F.col("list").desc(), units.desc())


def age_band(days: Column) -> Column:
    return band(days, [(30, "a) 0-30 days"), (90, "b) 31-90 days"), (180, "c) 91-180 days"), (365, "d) 181-365 days")],
                "e) over 365 days", closed=True)


@query("Inventory aging by days since the last restock")
def q66_aging(m: Retail) -> DataFrame:
    days = F.datediff(asof_day(m), F.col("last_restocked_date"))
    by = stock_value(m).filter(F.col("quantity_on_hand") > 0).groupBy(age_band(days).alias("stock_age")).agg(
        F.count("*").alias("positions"), F.sum("quantity_on_hand").alias("units"), F.sum("value").alias("v"))
    return part_of_total(by, "v", "share_of_value_pct", 1).select(
        "stock_age", "positions", "units", rnd("v", 0).alias("value_at_cost"), "share_of_value_pct").orderBy("stock_age")


def tiered_products(m: Retail, keep: str = "all") -> DataFrame:
    """Products with revenue of twelve months, units of 90 days, stock and the revenue quintile ``q``.
    ``keep`` names the products that are ranked: "all", "stocked" (with a stock row), "in_stock" (units > 0)."""
    last = asof_day(m)
    day = F.col("order_day")
    sales = since(sold_lines(m), F.date_add(last, -364), "order_day").groupBy("product_id").agg(
        F.sum("net_revenue").alias("r"), F.sum(F.when(within(day, last, 90), F.col("quantity"))).alias("u"))
    stock = stock_value(m).groupBy("product_id").agg(F.sum("quantity_on_hand").alias("units_in_stock"), F.sum("value").alias("value"))
    held = (m.products.select("product_id", "product_name").join(sales, "product_id", "left")
            .join(stock, "product_id", "left" if keep == "all" else "inner"))
    if keep == "in_stock":
        held = held.filter(F.col("units_in_stock") > 0)
    filled = held.select("product_id", "product_name", F.coalesce("r", F.lit(0.0)).alias("revenue_12m"),
                         F.coalesce("u", F.lit(0)).alias("units_90d"), F.coalesce("units_in_stock", F.lit(0)).alias("units_in_stock"), "value")
    return quantile_buckets(filled, 5, [F.col("revenue_12m").asc(), F.col("product_id").asc()], "q")


@query("High-revenue products with low stock")
def q67_high_revenue_low_stock(m: Retail, n: int = 20) -> DataFrame:
    cover = cover_days("units_in_stock", "units_90d")
    hit = tiered_products(m).withColumn("cover", cover).filter((F.col("q") == 5) & (F.col("units_90d") > 0) & (F.col("cover") < 30))
    days = rnd("cover", 1)
    return top(hit, n, days, F.col("revenue_12m").desc(), F.col("product_id")).select(
        "product_name", rnd("revenue_12m", 0).alias("revenue_12m"), "units_90d", "units_in_stock", days.alias("days_of_cover"))


@query("Low-revenue products with high stock")
def q68_low_revenue_high_stock(m: Retail, n: int = 20) -> DataFrame:
    cover = cover_days("units_in_stock", "units_90d")
    hit = tiered_products(m, "in_stock").withColumn("cover", cover).filter(
        (F.col("q") <= 2) & ((F.col("units_90d") == 0) | (F.col("cover") > 180)))
    return top(hit, n, F.col("value").desc(), F.col("product_id")).select(
        "product_name", rnd("revenue_12m", 0).alias("revenue_12m"), "units_90d", "units_in_stock",
        rnd("value", 0).alias("stock_value_at_cost"), rnd("cover", 0).alias("days_of_cover"))


@query("Revenue tier against stock tier")
def q69_class_matrix(m: Retail) -> DataFrame:
    label = stock_class(F.col("q"), F.col("units_90d"), F.col("units_in_stock"))
    return tiered_products(m, "stocked").groupBy(label.alias("product_class")).agg(
        F.count("*").alias("products"), rnd(F.sum("revenue_12m"), 0).alias("revenue_12m"),
        rnd(F.sum("value"), 0).alias("stock_value_at_cost")).orderBy("product_class")


@query("Monthly stock movements by type")
def q70_stock_movements(m: Retail) -> DataFrame:
    kind, change = F.col("transaction_type"), F.col("quantity_change")

    def moved(t: str) -> Column:
        return F.sum(F.when(kind == t, change))

    return m.inventory_transactions.groupBy(month_of("transaction_date").alias("month")).agg(
        moved("PURCHASE").alias("purchased"), (-moved("SALE")).alias("sold"), moved("RETURN").alias("returned_to_stock"),
        moved("ADJUSTMENT").alias("adjustments"), F.sum(F.when(kind != "OPENING", change)).alias("net_change")).orderBy("month")


@query("Stock-out risk and surplus by store")
def q71_store_risk(m: Retail) -> DataFrame:
    short, surplus = F.col("status").isin(SHORT), F.col("status").isin(SURPLUS)
    by = positions(m).groupBy("store_id").agg(
        F.count("*").alias("positions"), F.count_if(short).alias("stock_out_risk_positions"), F.sum(F.when(surplus, F.col("value"))).alias("s"),
        F.sum("value").alias("v"))
    return by.join(m.stores.select("store_id", "store_name"), "store_id").select(
        "store_name", "positions", "stock_out_risk_positions", pct("stock_out_risk_positions", "positions", 1).alias("stock_out_risk_pct"),
        rnd("s", 0).alias("surplus_value_at_cost"), pct("s", "v", 1).alias("surplus_share_of_store_value_pct")
    ).orderBy(F.col("surplus_value_at_cost").desc())
