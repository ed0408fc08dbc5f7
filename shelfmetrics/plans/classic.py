"""Classic query patterns on retail data (Q201-Q214)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import one_row, part_of_total, pct, ratio, rnd, top
from ..operators import consecutive_runs, not_in, percentiles, previous
from ..sources import Retail
from ..sources.layout import between_days
from .datasets import completed, sold_lines
from .registry import query
from .sales import monthly_revenue, revenue_by_store
from .stores import store_names


@query("Third-highest distinct order value")
def q201_third_value(m: Retail, place: int = 3) -> DataFrame:
    """Top-k over distinct values, so only k rows leave each task; no row when there are fewer values."""
    best = top(completed(m).select("total_amount").distinct(), place, F.col("total_amount").desc())
    return best.agg(F.min("total_amount").alias("third_highest_distinct_value"), F.count("*").alias("n")).filter(
        F.col("n") == place).drop("n")


@query("Duplicate customers to merge")
def q202_duplicate_customers(m: Retail, n: int = 10) -> DataFrame:
    """The survivor of an e-mail is the minimum of (registration, id); every other row of that e-mail is a duplicate."""
    key = F.lower(F.trim("email"))
    people = m.customers.filter(F.col("email").isNotNull()).select("customer_id", "first_name", "email", "registration_date", key.alias("key"))
    keep = people.groupBy("key").agg(F.min(F.struct("registration_date", "customer_id")).alias("s"), F.count("*").alias("rows")).filter(
        F.col("rows") > 1).select("key", F.col("s.customer_id").alias("survivor"))
    rest = people.join(keep, "key").filter(F.col("customer_id") != F.col("survivor"))
    return top(rest, n, F.col("email"), F.col("customer_id")).select(
        "customer_id", "first_name", "email", "registration_date", F.lit("duplicate - candidate to merge").alias("action"))


@query("Customers who bought from all of several categories")
def q203_bought_all(m: Retail, names: tuple[str, ...] = ("Mobiles & Accessories", "Grocery & Staples", "Footwear"), n: int = 10) -> DataFrame:
    wanted = m.categories.filter(F.col("category_name").isin(*names)).select("category_id")
    goods = m.products.select("product_id", "category_id").join(wanted, "category_id")
    per = sold_lines(m).join(goods, "product_id").groupBy("customer_id", "category_id").agg(F.sum("line_total").alias("s"))
    whole = per.groupBy("customer_id").agg(F.count("*").alias("categories_bought"), F.sum("s").alias("s")).filter(
        F.col("categories_bought") == len(names))
    return top(whole, n, F.col("s").desc(), F.col("customer_id")).select("customer_id", "categories_bought", rnd("s", 0).alias("total_spend"))


@query("Customers with three consecutive months")
def q204_three_months_running(m: Retail, months: int = 3) -> DataFrame:
    seen = completed(m).select("customer_id", (F.year("order_month") * 12 + F.month("order_month")).alias("month_no"))
    runs = consecutive_runs(seen, "customer_id", "month_no").filter(F.col("length") >= months)
    return runs.select("customer_id").distinct().agg(F.count("*").alias("customers_with_3_consecutive_months"))


@query("Year-to-date revenue")
def q205_year_to_date(m: Retail, year: int = 2025) -> DataFrame:
    year_rows = between_days(completed(m), *[F.make_date(F.lit(y), F.lit(1), F.lit(1)) for y in (year, year + 1)])
    by = year_rows.groupBy(F.col("order_month").alias("month")).agg(F.sum("net_amount").alias("net"))
    return by.select("month", rnd("net", 0).alias("revenue"),
                     rnd(F.sum("net").over(Window.partitionBy(F.year("month")).orderBy("month")), 0).alias("ytd_revenue")).orderBy("month")


@query("Mean and median order value per store")
def q206_store_median(m: Retail) -> DataFrame:
    middle = percentiles(completed(m).select("store_id", "total_amount"), "total_amount", {"p50": 0.5}, by=["store_id"])
    return revenue_by_store(m).join(middle, "store_id").join(store_names(m), "store_id").select(
        "store_name", rnd(ratio("gross", "orders"), 0).alias("mean_order_value"), rnd("p50", 0).alias("median_order_value")
    ).orderBy(F.col("mean_order_value").desc())


@query("Top three products per category, ties kept")
def q207_top_with_ties(m: Retail, first_id: int = 1, last_id: int = 3, n: int = 3) -> DataFrame:
    goods = m.products.filter(F.col("category_id").between(first_id, last_id)).select("product_id", "product_name", "category_id")
    by = (m.sales_order_items.select("order_id", "product_id", "quantity").join(completed(m).select("order_id"), "order_id")
          .groupBy("product_id").agg(F.sum("quantity").alias("u")).join(goods, "product_id")
          .groupBy("category_id", "product_name").agg(F.sum("u").alias("units")))
    ranked = by.withColumn("dr", F.dense_rank().over(Window.partitionBy("category_id").orderBy(F.col("units").desc())))
    return ranked.filter(F.col("dr") <= n).join(m.categories.select("category_id", "category_name"), "category_id").select(
        "category_name", "product_name", "units", "dr").orderBy("category_name", "dr")


@query("Customers whose last three order values kept rising")
def q208_rising_orders(m: Retail) -> DataFrame:
    last = Window.partitionBy("customer_id").orderBy(F.col("order_date").desc(), F.col("order_id").desc())
    recent = completed(m).select("customer_id", "total_amount", "order_date", "order_id").withColumn("place", F.row_number().over(last)).filter(
        F.col("place") <= 3)

    def at(k: int):
        return F.max(F.when(F.col("place") == k, F.col("total_amount")))

    three = recent.groupBy("customer_id").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    return three.agg(F.count_if((F.col("a") > F.col("b")) & (F.col("b") > F.col("c"))).alias("customers_rising_three_orders"),
                     F.count_if(F.col("c").isNotNull()).alias("customers_with_three_orders"))


@query("Employees hired before their manager")
def q209_hired_before_manager(m: Retail, n: int = 10) -> DataFrame:
    full = F.concat("first_name", F.lit(" "), "last_name")
    staff = m.employees.select("employee_id", full.alias("employee"), F.col("hire_date").alias("employee_hired"), F.col("manager_id").alias("boss"))
    bosses = m.employees.select(F.col("employee_id").alias("boss"), full.alias("manager"), F.col("hire_date").alias("manager_hired"))
    early = staff.join(bosses, "boss").filter(F.col("employee_hired") < F.col("manager_hired"))
    return top(early, n, F.col("employee_hired"), F.col("employee_id")).select("employee", "employee_hired", "manager", "manager_hired")


@query("Products priced above their category average")
def q210_above_category_average(m: Retail) -> DataFrame:
    priced = m.products.filter(F.col("category_id").isNotNull()).select("category_id", "unit_price")
    mean = priced.groupBy("category_id").agg(ratio(F.sum("unit_price"), F.count("*")).alias("mean"))
    return priced.join(mean, "category_id").filter(F.col("unit_price").cast("double") > F.col("mean")).agg(
        F.count("*").alias("via_window_function"))


@query("NOT IN with NULLs against NOT EXISTS")
def q211_not_in_trap(m: Retail) -> DataFrame:
    trap = not_in(m.categories, m.products, "category_id").agg(F.count("*").alias("not_in_result"))
    honest = m.categories.join(m.products.select("category_id"), "category_id", "left_anti").agg(F.count("*").alias("not_exists_result"))
    return one_row(trap, honest)


@query("Months by direction of change")
def q212_month_movements(m: Retail) -> DataFrame:
    before = previous("net", "month")
    net = F.col("net").cast("double")
    label = (F.when(before.isNull(), "first month").when(net > 1.02 * before.cast("double"), "growth (more than +2 pct)")
             .when(net < 0.98 * before.cast("double"), "decline (more than -2 pct)").otherwise("flat (within 2 pct)"))
    return monthly_revenue(m).select(label.alias("movement")).groupBy("movement").agg(F.count("*").alias("months")).orderBy(F.col("months").desc())


@query("Products sold in every physical store")
def q213_sold_everywhere(m: Retail) -> DataFrame:
    physical = m.stores.filter(F.col("store_type") == "STORE").select("store_id")
    need = physical.agg(F.count("*")).scalar()
    sold = (m.sales_order_items.select("order_id", "product_id").join(completed(m).select("order_id", "store_id"), "order_id")
            .join(physical, "store_id", "left_semi").select("product_id", "store_id").distinct())
    full = sold.groupBy("product_id").agg(F.count("*").alias("n")).filter(F.col("n") == need)
    return full.join(m.products.select("product_id"), "product_id", "left_semi").agg(F.count("*").alias("products_sold_in_every_store"))


@query("Share of each store in its region")
def q214_share_of_region(m: Retail) -> DataFrame:
    by = revenue_by_store(m).join(m.stores.select("store_id", "store_name", "region"), "store_id")
    return by.select("region", "store_name", rnd("net", 0).alias("revenue"),
                     pct("net", F.sum("net").over(Window.partitionBy("region")), 1).alias("share_of_region_pct")).orderBy(
        "region", F.col("revenue").desc())
