"""Hierarchies, sets, islands, percentiles and date bucketing (Q100-Q115)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import as_double, growth_pct, part_of_total, pct, ratio, rnd, stacked, top, week_of
from ..operators import consecutive_runs, descend, gap_days, percentiles, previous, trailing_mean
from ..sources import Retail
from ..sources.layout import between_days
from .datasets import NO_CATEGORY, asof_day, canonical_products, completed, sold_lines
from .registry import query
from .sales import product_totals
from .stores import store_names


@query("Category hierarchy with path and direct product count")
def q100_category_tree(m: Retail) -> DataFrame:
    tree = descend(m.categories, "category_id", "parent_category_id", "category_name")
    direct = m.products.groupBy("category_id").agg(F.count("*").alias("n"))
    return tree.join(direct, "category_id", "left").groupBy("path", "depth").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("direct_products")).orderBy("path")


@query("Revenue rolled up to root categories")
def q101_root_categories(m: Retail) -> DataFrame:
    tree = descend(m.categories, "category_id", "parent_category_id", "category_name").select("category_id", "root")
    roots = tree.join(m.categories.select(F.col("category_id").alias("root"), F.col("category_name").alias("top_level_category")), "root")
    by = (product_totals(m).join(m.products.select("product_id", "category_id"), "product_id").groupBy("category_id")
          .agg(F.sum("net").alias("n")).join(roots, "category_id").groupBy("top_level_category").agg(F.sum("n").alias("net")))
    return part_of_total(by, "net", "share_pct", 1).select("top_level_category", rnd("net", 0).alias("net_revenue"), "share_pct").orderBy(
        F.col("net_revenue").desc())


@query("Depth of the employee reporting chain per store")
def q102_reporting_depth(m: Retail) -> DataFrame:
    org = descend(m.employees.withColumn("who", F.concat("first_name", F.lit(" "), "last_name")), "employee_id", "manager_id", "who")
    placed = org.join(m.employees.select("employee_id", "store_id"), "employee_id")
    depth = F.col("depth")
    return placed.groupBy("store_id").agg(F.count_if(depth == 1).alias("managers"), F.count_if(depth == 2).alias("direct_reports"),
                                          F.max(depth).alias("max_depth")).join(store_names(m), "store_id").select(
        "store_name", "managers", "direct_reports", "max_depth").orderBy("store_name")


@query("Categories without sales and sales without a category")
def q103_category_mismatch(m: Retail) -> DataFrame:
    sold = (product_totals(m).join(m.products.select("product_id", F.col("category_id").alias("sold_category")), "product_id")
            .groupBy("sold_category").agg(F.sum("net").alias("net")))
    both = m.categories.select("category_id", "category_name").join(sold, F.col("category_id") == F.col("sold_category"), "full_outer")
    kind = (F.when(F.col("category_id").isNull(), "Sales without a category").when(F.col("net").isNull(), "Category without sales")
            .otherwise("Matched"))
    return both.filter(F.col("category_id").isNull() | F.col("net").isNull()).select(
        F.coalesce("category_name", F.lit("(products with NO category)")).alias("category"), kind.alias("match_type"),
        rnd("net", 0).alias("revenue")).orderBy("match_type", "category")


@query("Retained, lapsed and new customers between two years")
def q104_customer_sets(m: Retail, before: int = 2024, year: int = 2025) -> DataFrame:
    def bought(y: int) -> DataFrame:
        return completed(m).filter(F.col("order_year") == y).select("customer_id")

    def size(df: DataFrame, label: str) -> DataFrame:
        return df.agg(F.lit(label).alias("segment"), F.count("*").alias("customers"))

    old, new = bought(before), bought(year)
    return stacked(size(old.intersect(new), f"Bought in {before} and {year} (retained)"),
                   size(old.subtract(new), f"Bought in {before} but not in {year} (lapsed)"),
                   size(new.subtract(old), f"Bought in {year} but not in {before} (new or returning)"))


@query("Days without sales of one store")
def q105_days_without_sales(m: Retail, store_code: str = "LKO01", first: str = "2025-12-01", last: str = "2025-12-31") -> DataFrame:
    a, z = F.lit(first).cast("date"), F.lit(last).cast("date")
    store = m.stores.filter(F.col("store_code") == store_code).select("store_id")
    open_days = between_days(completed(m), a, F.date_add(z, 1)).join(
        store, "store_id", "left_semi").select(F.col("order_day").alias("day"))
    days = m.spark.range(1).select(F.explode(F.sequence(a, z)).alias("day"))
    return days.join(open_days, "day", "left_anti").select("day", F.date_format("day", "EEE").alias("weekday")).orderBy("day")


@query("Longest run of consecutive trading days per store")
def q106_trading_streaks(m: Retail) -> DataFrame:
    days = completed(m).select("store_id", F.unix_date("order_day").alias("d"))
    runs = consecutive_runs(days, "store_id", "d")
    best = runs.groupBy("store_id").agg(F.max(F.struct("length", (-F.col("first")).alias("k"), "last")).alias("b"))
    return best.join(store_names(m), "store_id").select(
        "store_name", F.date_from_unix_date((-F.col("b.k")).cast("int")).alias("streak_start"),
        F.date_from_unix_date(F.col("b.last").cast("int")).alias("streak_end"), F.col("b.length").alias("days_in_streak")
    ).orderBy(F.col("days_in_streak").desc())


@query("Top three products of every store")
def q107_top_products_per_store(m: Retail, n: int = 3) -> DataFrame:
    """The rank filter is pushed below the shuffle as a group limit: a task passes at most n rows per store on."""
    names = m.products.select("product_id", "product_name")
    by = (sold_lines(m).groupBy("store_id", "product_id").agg(F.sum("net_revenue").alias("n")).join(names, "product_id")
          .groupBy("store_id", "product_name").agg(F.sum("n").alias("net")))
    best = by.withColumn("place", F.row_number().over(Window.partitionBy("store_id").orderBy(F.col("net").desc(), "product_name")))
    return best.filter(F.col("place") <= n).join(store_names(m), "store_id").orderBy("store_name", F.col("net").desc()).select(
        "store_name", "product_name", rnd("net", 0).alias("net_revenue"))


def far_above_average(m: Retail, floor: float, times: float) -> DataFrame:
    """Completed orders above ``floor`` and above ``times`` the customer's own mean."""
    mean = completed(m).groupBy("customer_id").agg(ratio(F.sum("total_amount"), F.count("*")).alias("mean"))
    big = completed(m).filter(F.col("total_amount") > floor).select("order_id", "customer_id", "total_amount")
    return big.join(mean, "customer_id").filter(as_double("total_amount") > times * F.col("mean"))


@query("Orders far above the customer's own average")
def q108_outsized_orders(m: Retail, floor: float = 100000, times: float = 3, n: int = 10) -> DataFrame:
    return top(far_above_average(m, floor, times), n, F.col("total_amount").desc(), F.col("order_id")).select(
        "order_id", "customer_id", "total_amount", rnd("mean", 0).alias("customer_avg_order"))


@query("Category by region revenue cross-tab")
def q109_category_region(m: Retail, regions: tuple[str, ...] = ("North", "South", "East", "West"), share_of: str = "West") -> DataFrame:
    cats = canonical_products(m).filter(F.col("canonical_id").isNotNull()).select("product_id", F.col("canonical_name").alias("category_name"))
    cells = (sold_lines(m).groupBy("product_id", "store_id").agg(F.sum("net_revenue").alias("net")).join(cats, "product_id")
             .join(m.stores.select("store_id", "region"), "store_id").groupBy("category_name", "region").agg(F.sum("net").alias("net")))

    def cell(r: str):
        return F.sum(F.when(F.col("region") == r, F.col("net")))

    def name(r: str) -> str:
        return r.lower().replace(" ", "_")

    return cells.groupBy("category_name").agg(
        *[rnd(cell(r), 0).alias(name(r)) for r in regions],
        pct(cell(share_of), F.sum("net"), 1).alias(f"{name(share_of)}_share_pct")).orderBy("category_name")


@query("Order value percentiles and outliers per channel")
def q110_value_percentiles(m: Retail) -> DataFrame:
    orders = completed(m).select("channel", "total_amount")
    stats = percentiles(orders, "total_amount", {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p99": 0.99}, by=["channel"]).withColumn(
        "fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    out = as_double("total_amount") > F.col("fence")
    return orders.join(stats, "channel").groupBy("channel", "median", "p90", "p99", "fence").agg(
        F.count("*").alias("n"), F.count_if(out).alias("outlier_orders")).select(
        "channel", rnd("median", 0).alias("median"), rnd("p90", 0).alias("p90"), rnd("p99", 0).alias("p99"), rnd("fence", 0).alias("outlier_fence"),
        "outlier_orders", pct("outlier_orders", "n", 1).alias("outlier_share_pct"))


@query("Weekly revenue, change and four-week mean, last twelve weeks")
def q111_weekly_revenue(m: Retail, weeks: int = 12) -> DataFrame:
    w = completed(m).groupBy(week_of("order_day").alias("week_start")).agg(F.sum("net_amount").alias("net"))
    calc = w.select("week_start", rnd("net", 0).alias("revenue"), growth_pct("net", previous("net", "week_start"), 1).alias("wow_change_pct"),
                    rnd(trailing_mean("net", "week_start", 4, only_full=False), 0).alias("moving_avg_4w"))
    return top(calc, weeks, F.col("week_start").desc())


@query("Cumulative customer acquisition")
def q112_acquisition(m: Retail) -> DataFrame:
    first = completed(m).groupBy("customer_id").agg(F.min("order_month").alias("month"))
    by = first.groupBy("month").agg(F.count("*").alias("new_customers"))
    return by.withColumn("cumulative_customers", F.sum("new_customers").over(Window.orderBy("month"))).orderBy("month")


@query("Repeat rate by the category of the first purchase")
def q113_first_purchase(m: Retail, min_customers: int = 100) -> DataFrame:
    """First order by (date, id) and its largest line are minimum and maximum of a struct: partial aggregation, no sort."""
    first = completed(m).groupBy("customer_id").agg(F.min(F.struct("order_date", "order_id")).alias("f"), F.count("*").alias("orders"))
    lines = m.sales_order_items.select("order_id", "product_id", "line_total")
    picked = first.select("customer_id", "orders", F.col("f.order_id").alias("order_id")).join(lines, "order_id").groupBy("customer_id", "orders").agg(
        F.max(F.struct("line_total", (-F.col("product_id")).alias("k"), "product_id")).alias("b"))
    cats = m.products.select("product_id", "category_id").join(m.categories.select("category_id", "category_name"), "category_id", "left")
    named = picked.select("customer_id", "orders", F.col("b.product_id").alias("product_id")).join(cats, "product_id")
    return named.groupBy(F.coalesce("category_name", F.lit(NO_CATEGORY)).alias("first_purchase_category")).agg(
        F.count("*").alias("customers"), pct(F.count_if(F.col("orders") >= 2), F.count("*"), 1).alias("repeat_rate_pct")).filter(
        F.col("customers") >= min_customers).orderBy(F.col("repeat_rate_pct").desc())


@query("Reactivated customers after a long silence")
def q114_reactivated(m: Retail, silence: int = 180) -> DataFrame:
    gaps = gap_days(completed(m), "customer_id", "order_day").filter(F.col("gap_days") > silence)
    per = gaps.groupBy("customer_id").agg(F.sum("events").alias("n"), F.sum("gap_days").alias("s"), F.max("gap_days").alias("g"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reactivation_orders"), F.count("*").alias("reactivated_customers"),
                   rnd(ratio(F.sum("s"), F.sum("n")), 0).alias("avg_silence_days"), F.max("g").alias("longest_silence_days"))


@query("Time to the second order")
def q115_second_order(m: Retail, settle: int = 90) -> DataFrame:
    days = completed(m).groupBy("customer_id", "order_day").agg(F.count("*").alias("n"))
    first = days.groupBy("customer_id").agg(F.min("order_day").alias("first"))
    after = days.join(first, "customer_id").groupBy("customer_id", "first").agg(
        F.max(F.when(F.col("order_day") == F.col("first"), F.col("n"))).alias("n"),
        F.min(F.when(F.col("order_day") > F.col("first"), F.col("order_day"))).alias("later"))
    wait = F.when(F.col("n") > 1, F.lit(0)).otherwise(F.datediff("later", "first"))
    known = after.filter(F.col("first") <= F.date_sub(asof_day(m), settle)).select(wait.alias("wait"))
    return known.agg(F.count("*").alias("customers_measured"), *[
        pct(F.count_if(F.col("wait") <= d), F.count("*"), 1).alias(f"second_order_within_{d}d_pct") for d in (30, 60, 90)],
        pct(F.count_if(F.col("wait").isNull()), F.count("*"), 1).alias("never_came_back_pct"))
