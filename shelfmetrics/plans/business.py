"""Management questions that combine several analyses (Q401-Q405)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cover_days, growth_pct, one_row, pct, ratio, rnd, top
from ..operators import abc_classes, quantile_buckets
from ..sources import Retail
from .customers import customer_orders
from .datasets import asof_day, completed, flag_returns, sold_lines, stock_value, units_returned, within
from .products import class_summary
from .registry import query
from .sales import product_totals


@query("Executive KPI row")
def q401_executive_kpis(m: Retail) -> DataFrame:
    people = customer_orders(m).agg(
        F.count("*").alias("buying_customers"), F.sum("orders").alias("completed_orders"), F.sum("net").alias("net"), F.sum("gross").alias("gross"),
        F.count_if(F.col("orders") >= 2).alias("repeat"))
    row = one_row(people, sold_lines(m).agg(F.sum("gross_profit").alias("profit")),
                  m.returns.select("order_id").distinct().agg(F.count("*").alias("back")), stock_value(m).agg(F.sum("value").alias("stock")))
    return row.select(
        rnd("net", 0).alias("net_revenue"), rnd("profit", 0).alias("gross_profit"), "completed_orders", "buying_customers",
        rnd(ratio("gross", "completed_orders"), 0).alias("avg_order_value"), pct("repeat", "buying_customers", 1).alias("repeat_customer_rate_pct"),
        pct("back", "completed_orders", 2).alias("order_return_rate_pct"), rnd("stock", 0).alias("inventory_value_at_cost"))


@query("Class-A products with warning flags")
def q402_products_to_review(m: Retail, before: int = 2024, year: int = 2025, drop: float = 0.85, return_limit: float = 3, cover_limit: float = 30,
                            n: int = 20) -> DataFrame:
    last = asof_day(m)

    def in_year(y: int):
        return F.sum(F.when(F.col("order_year") == y, F.col("net_revenue")))

    per = sold_lines(m).groupBy("product_id").agg(
        F.sum("net_revenue").alias("net"), F.sum("gross_profit").alias("profit"), in_year(before).alias("old"), in_year(year).alias("new"),
        F.sum(F.when(within(F.col("order_day"), last, 90), F.col("quantity"))).alias("u90"), F.sum("quantity").alias("units"))
    classed = abc_classes(per, "net", "product_id")
    company = classed.agg(pct(F.sum("profit"), F.sum("net"))).scalar()
    stock = m.inventory.groupBy("product_id").agg(F.sum("quantity_on_hand").alias("held"))
    best = (classed.filter(F.col("abc_class") == "A").join(stock, "product_id", "left").join(units_returned(m), "product_id", "left")
            .withColumns({"margin": pct("profit", "net"), "back": pct(F.coalesce("units_returned", F.lit(0)), "units"),
                          "cover": cover_days(F.coalesce("held", F.lit(0)), "u90"), "company": company}))
    flags = [(F.col("margin") < F.col("company"), "margin below company average"),
             (F.col("new") < drop * F.col("old"), "revenue down more than 15 pct"),
             (F.col("back") > return_limit, "return rate above 3 pct"), (F.col("cover") < cover_limit, "under 30 days of stock")]
    marked = best.withColumn("flags", F.concat_ws("; ", *[F.when(hit, text) for hit, text in flags])).filter(F.col("flags") != "")
    return top(marked, n, F.col("net").desc(), F.col("product_id")).join(m.products.select("product_id", "product_name"), "product_id").orderBy(
        F.col("net").desc(), "product_id").select(
        "product_name", rnd("net", 0).alias("net_revenue"), rnd("margin", 1).alias("margin_pct"),
        growth_pct("new", "old", 1).alias(f"growth_{year}_pct"), rnd("back", 1).alias("return_rate_pct"), rnd("cover", 0).alias("days_of_cover"), "flags")


@query("Twelve labelled operational metrics")
def q403_operational_metrics(m: Retail, years: tuple[int, int, int] = (2023, 2024, 2025)) -> DataFrame:
    """One pass per fact, then the row is turned into one line per metric."""
    oldest, before, year = years
    web, in_year = F.col("channel") == "ONLINE", F.col("order_year")

    def net(hit):
        return F.sum(F.when(hit, F.col("net_amount")))

    orders = flag_returns(m, completed(m)).agg(
        growth_pct(net(in_year == year), net(in_year == before), 1).alias("growth"),
        pct(net((in_year == year) & web), net(in_year == year), 1).alias("web_now"),
        pct(net((in_year == oldest) & web), net(in_year == oldest), 1).alias("web_then"),
        pct(F.count_if(web & F.col("has_return")), F.count_if(web), 2).alias("back_web"),
        pct(F.count_if(~web & F.col("has_return")), F.count_if(~web), 2).alias("back_store"))
    promo = F.col("promotion_id").isNotNull()
    lines = sold_lines(m).agg(*[
        pct(F.sum(F.when(hit, F.col("gross_profit"))), F.sum(F.when(hit, F.col("net_revenue"))), 1).alias(name)
        for name, hit in (("promo", promo), ("plain", ~promo))])
    deciles = quantile_buckets(customer_orders(m).select("customer_id", "net"), 10, [F.col("net").asc(), F.col("customer_id").asc()], "decile")
    buyers = deciles.agg(pct(F.sum(F.when(F.col("decile") == 10, F.col("net"))), F.sum("net"), 1).alias("top_buyers"))
    placed = abc_classes(product_totals(m).select("product_id", "net"), "net", "product_id")
    products = placed.agg(pct(F.sum(F.when(F.col("row_no") <= F.col("row_count") * 0.2, F.col("net"))), F.sum("net"), 1).alias("top_products"))
    pos = m.purchases.filter(F.col("status") == "RECEIVED").agg(
        pct(F.count_if(F.col("received_date") <= F.col("expected_date")), F.count("*"), 1).alias("on_time"))
    held = F.col("quantity_on_hand")
    stock = m.inventory.agg(
        pct(F.count_if((held > 0) & (held <= F.col("reorder_level"))), F.count("*"), 1).alias("low"),
        pct(F.count_if(held > F.col("max_stock_level")), F.count("*"), 1).alias("over"))
    labels = [
        ("growth", "Growth", f"Net revenue growth {year} vs {before} (pct)"),
        ("web_now", "Channel", f"Online share of net revenue in {year} (pct)"),
        ("web_then", "Channel", f"Online share of net revenue in {oldest} (pct)"),
        ("promo", "Promotions", "Gross margin on promoted lines (pct)"),
        ("plain", "Promotions", "Gross margin on non-promoted lines (pct)"),
        ("top_buyers", "Customers", "Share of revenue from the top 10 pct of buyers (pct)"),
        ("top_products", "Products", "Share of revenue from the top 20 pct of products (pct)"),
        ("back_web", "Returns", "Order return rate, online (pct)"),
        ("back_store", "Returns", "Order return rate, in-store (pct)"),
        ("on_time", "Suppliers", "On-time delivery, all received POs (pct)"),
        ("low", "Inventory", "Positions at or below reorder level but not empty (pct)"),
        ("over", "Inventory", "Positions above max stock level (pct)")]
    row = one_row(orders, lines, buyers, products, pos, stock)
    named = F.array(*[F.struct(F.lit(t).alias("theme"), F.lit(x).alias("metric"), F.col(c).alias("value")) for c, t, x in labels])
    return row.select(F.inline(named))


@query("ABC classes of inventory value")
def q404_inventory_abc(m: Retail) -> DataFrame:
    by = stock_value(m).groupBy("product_id").agg(F.sum("value").alias("value"), F.sum("quantity_on_hand").alias("units")).filter(
        F.col("units") > 0).select("product_id", "value")
    return class_summary(abc_classes(by, "value", "product_id"), "inventory_abc_class", "value",
                         ("share_of_products_pct", "stock_value_at_cost", "share_of_value_pct"))
