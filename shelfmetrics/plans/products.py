"""Product profitability, growth, Pareto and concentration (Q47-Q58)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import as_double, band, growth_pct, part_of_total, pct, ratio, rnd, top
from ..operators import abc_classes, pair_counts
from ..sources import Retail
from .basics import PRICE_BANDS, TOP_PRICE_BAND
from .datasets import NO_BRAND, NO_CATEGORY, canonical_products, completed, sold_lines, stock_value, units_returned
from .registry import query
from .sales import product_totals


def yearly_revenue(df: DataFrame, years: tuple[int, ...], *keys: str, measure: str = "net_revenue") -> DataFrame:
    """One revenue column per year (``rev_<year>``): a conditional-sum pivot over fixed years."""
    return df.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("order_year") == y, F.col(measure))).alias(f"rev_{y}") for y in years])


@query("Product scorecard, top twenty by revenue")
def q47_product_scorecard(m: Retail, n: int = 20) -> DataFrame:
    """The rank of the best n rows is their place among themselves, so nothing but the top n is ordered."""
    best = top(product_totals(m), n, F.col("net").desc(), F.col("product_id"))
    ranked = best.withColumn("revenue_rank", F.rank().over(Window.orderBy(F.col("net").desc())))
    back = units_returned(m).join(best.select("product_id"), "product_id", "left_semi")
    return (ranked.join(m.products.select("product_id", "product_name"), "product_id").join(back, "product_id", "left").select(
        "product_id", "product_name", F.col("units").alias("units_sold"), rnd("net", 0).alias("net_revenue"),
        rnd("profit", 0).alias("gross_profit"), pct("profit", "net", 1).alias("margin_pct"),
        pct(F.coalesce("units_returned", F.lit(0)), "units", 2).alias("return_rate_pct"), "revenue_rank")
        .orderBy("revenue_rank", "product_id"))


@query("Best-selling product of every category, case variants merged")
def q48_category_bestseller(m: Retail) -> DataFrame:
    named = canonical_products(m).filter(F.col("canonical_id").isNotNull()).select(
        "product_id", "product_name", F.col("canonical_id").alias("category_id"), F.col("canonical_name").alias("category_name"))
    best = product_totals(m).join(named, "product_id").groupBy("category_id", "category_name").agg(
        F.max(F.struct("net", (-F.col("product_id")).alias("k"), "product_name")).alias("b"), F.sum("net").alias("whole"))
    return best.orderBy(F.col("b.net").desc()).select(
        "category_name", "b.product_name", rnd("b.net", 0).alias("net_revenue"), pct("b.net", "whole", 1).alias("share_of_category_pct"))


@query("Products without a completed sale, with their stock value")
def q49_never_sold(m: Retail) -> DataFrame:
    sold = m.sales_order_items.select("order_id", "product_id").join(completed(m).select("order_id"), "order_id").select("product_id")
    stock = stock_value(m).groupBy("product_id").agg(F.sum("quantity_on_hand").alias("units"), F.sum("value").alias("value"))
    return (m.products.join(sold, "product_id", "left_anti").join(stock, "product_id", "left").select(
        "product_id", "sku", "product_name", "is_active", F.coalesce("units", F.lit(0)).alias("units_in_stock"),
        rnd(F.coalesce("value", F.lit(0)), 0).alias("stock_value_at_cost")).orderBy(F.col("stock_value_at_cost").desc(), "product_id"))


def trend_flag(years: tuple[int, int, int], a: str, b: str, c: str):
    worse = F.col(c) < F.col(b)
    return (F.when(worse & (F.col(b) < F.col(a)), "Declining two years in a row").when(worse, f"Declined in {years[2]}")
            .otherwise("Growing / stable"))


@query("Category growth by year with a trend flag")
def q50_category_growth(m: Retail, years: tuple[int, int, int] = (2023, 2024, 2025)) -> DataFrame:
    per = yearly_revenue(sold_lines(m), years, "product_id")
    names = canonical_products(m).select("product_id", F.coalesce("canonical_name", F.lit(NO_CATEGORY)).alias("category"))
    a, b, c = (f"rev_{y}" for y in years)
    by = per.join(names, "product_id").groupBy("category").agg(*[F.sum(x).alias(x) for x in (a, b, c)])
    return by.select(
        "category", *[rnd(x, 0).alias(x) for x in (a, b, c)], growth_pct(b, a, 1).alias(f"growth_{years[1]}_pct"),
        growth_pct(c, b, 1).alias(f"growth_{years[2]}_pct"), trend_flag(years, a, b, c).alias("trend_flag")
    ).orderBy(f"growth_{years[2]}_pct")


@query("Products declining year over year, with a volume floor")
def q51_declining_products(m: Retail, before: int = 2024, year: int = 2025, min_units: int = 30, keep: float = 0.8, n: int = 25) -> DataFrame:
    def in_year(y: int, c: str):
        return F.sum(F.when(F.col("order_year") == y, F.col(c)))

    lines = sold_lines(m).filter(F.col("order_year").isin(before, year))
    per = lines.groupBy("product_id").agg(
        in_year(before, "net_revenue").alias("old"), in_year(year, "net_revenue").alias("new"), in_year(before, "quantity").alias("units"),
        in_year(before, "line_total").alias("old_gross"), in_year(year, "line_total").alias("new_gross"))
    fell = per.filter((F.col("units") >= min_units) & (as_double("new_gross") <= keep * as_double("old_gross")))
    change = growth_pct("new_gross", "old_gross")
    worst = top(fell.withColumn("change", change), n, F.col("change"), F.col("product_id"))
    return worst.join(m.products.select("product_id", "product_name", "is_active"), "product_id").orderBy("change", "product_id").select(
        "product_id", "product_name", "is_active", rnd("old", 0).alias(f"rev_{before}"), rnd("new", 0).alias(f"rev_{year}"),
        rnd("change", 1).alias("change_pct"))


def class_summary(df: DataFrame, cls: str, value: str, names: tuple[str, str, str]) -> DataFrame:
    by = df.groupBy(F.col("abc_class").alias(cls)).agg(F.count("*").alias("products"), F.sum(value).alias("v"))
    shared = part_of_total(part_of_total(by, "products", names[0], 1), "v", names[2], 1)
    return shared.select(cls, "products", names[0], rnd("v", 0).alias(names[1]), names[2]).orderBy(cls)


@query("Pareto classes of products by revenue")
def q52_abc_products(m: Retail) -> DataFrame:
    classed = abc_classes(product_totals(m).select("product_id", "net"), "net", "product_id")
    return class_summary(classed, "abc_class", "net", ("share_of_products_pct", "net_revenue", "share_of_revenue_pct"))


def concentration_row(classed: DataFrame, value: str):
    """Shares of the top 10, top 50 and top fifth of the rows, and the sum of squared shares."""
    share, place = F.col(value) / F.col("total_value"), F.col("row_no")
    return classed.agg(
        F.max("row_count").alias("products_sold"),
        rnd(F.lit(100.0) * F.sum(F.when(place <= 10, share)), 1).alias("top_10_products_share_pct"),
        rnd(F.lit(100.0) * F.sum(F.when(place <= 50, share)), 1).alias("top_50_products_share_pct"),
        rnd(F.lit(100.0) * F.sum(F.when(place <= F.col("row_count") * 0.2, share)), 1).alias("top_20pct_products_share_pct"),
        rnd(F.sum(share * share), 4).alias("herfindahl_index"))


@query("Sales concentration over products")
def q53_concentration(m: Retail) -> DataFrame:
    return concentration_row(abc_classes(product_totals(m).select("product_id", "net"), "net", "product_id"), "net")


@query("Three highest-margin products of every category, with a volume floor")
def q54_best_margins(m: Retail, min_units: int = 50, n: int = 3) -> DataFrame:
    margins = product_totals(m).filter(F.col("units") >= min_units).withColumn("margin", F.col("profit") / F.col("net"))
    named = margins.join(m.products.select("product_id", "product_name", F.coalesce("category_id", F.lit(0)).alias("category_id")), "product_id")
    ranked = named.withColumn("margin_rank", F.rank().over(Window.partitionBy("category_id").orderBy(F.col("margin").desc())))
    best = ranked.filter(F.col("margin_rank") <= n)
    return best.join(m.categories.select("category_id", "category_name"), "category_id", "left").select(
        F.coalesce("category_name", F.lit(NO_CATEGORY)).alias("category"), "product_name", "units",
        rnd(F.lit(100.0) * F.col("margin"), 1).alias("margin_pct"), "margin_rank").orderBy("category", "margin_rank")


def product_group(m: Retail, label, name: str) -> DataFrame:
    """Sold products grouped by an attribute of the product."""
    kinds = m.products.select("product_id", label.alias(name))
    return product_totals(m).join(kinds, "product_id").groupBy(name).agg(
        F.count("*").alias("products"), F.sum("units").alias("units"), F.sum("net").alias("net"), F.sum("profit").alias("profit"))


@query("Performance by price band")
def q55_price_bands(m: Retail) -> DataFrame:
    by = product_group(m, band("unit_price", PRICE_BANDS, TOP_PRICE_BAND), "price_band")
    return part_of_total(by, "net", "revenue_share_pct", 1).select(
        "price_band", F.col("products").alias("products_sold"), "units", rnd("net", 0).alias("net_revenue"), "revenue_share_pct",
        pct("profit", "net", 1).alias("margin_pct")).orderBy("price_band")


@query("Products bought together")
def q56_bought_together(m: Retail, min_orders: int = 5, n: int = 10) -> DataFrame:
    lines = (m.sales_order_items.select("order_id", "product_id").join(m.products.select("product_id", "product_name"), "product_id")
             .join(completed(m).select("order_id"), "order_id"))  # orders last: the pairs then find the lines by order
    pairs = pair_counts(lines, "order_id", "product_id", "product_name", sizes=m.sales_order_items.select("order_id")).filter(F.col("together") >= min_orders)
    return top(pairs, n, F.col("together").desc(), F.col("label_a"), F.col("label_b")).select(
        F.col("label_a").alias("product_a"), F.col("label_b").alias("product_b"), F.col("together").alias("orders_together"))


@query("Revenue by launch group")
def q57_launch_groups(m: Retail, first_year: int = 2023) -> DataFrame:
    launched = F.year("launch_date")
    label = F.when(launched < first_year, f"Launched before {first_year}").otherwise(F.concat(F.lit("Launched in "), launched))
    return part_of_total(product_group(m, label, "launch_group"), "net", "revenue_share_pct", 1).select(
        "launch_group", F.col("products").alias("products_sold"), rnd("net", 0).alias("net_revenue"), "revenue_share_pct").orderBy("launch_group")


@query("Top ten brands")
def q58_top_brands(m: Retail, n: int = 10) -> DataFrame:
    by = product_group(m, F.coalesce("brand", F.lit(NO_BRAND)), "brand")
    return top(by, n, F.col("net").desc(), F.col("brand")).select(
        "brand", "products", "units", rnd("net", 0).alias("net_revenue"), pct("profit", "net", 1).alias("margin_pct"))
