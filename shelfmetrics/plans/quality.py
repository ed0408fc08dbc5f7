"""Data-quality scorecard and details (Q301-Q309). The patterns are fixed values."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import one_row, pct, rnd, stacked, top
from ..sources import Retail
from .datasets import completed
from .registry import query
from .stores import store_names

EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+[.][A-Za-z]{2,}$"
PHONE_PATTERN = "^(91)?[6-9][0-9]{9}$"

# Check id, table, name, severity (fixed values).
CHECK_LIST = [
    ("DQ01", "customers", "Duplicate-like customers (same e-mail ignoring case/spaces)", "Medium"),
    ("DQ02", "customers", "NULL e-mail", "Low"),
    ("DQ03", "customers", "NULL phone", "Low"),
    ("DQ04", "customers", "Invalid e-mail format", "Medium"),
    ("DQ05", "customers", "Invalid phone number (not a 10-digit Indian mobile)", "Medium"),
    ("DQ06", "customers", "Implausible date of birth (before 1920 or in the future)", "Medium"),
    ("DQ07", "customers", "Inconsistent name capitalisation or trailing spaces", "Low"),
    ("DQ08", "customers", "Missing city", "Low"),
    ("DQ09", "customers", "No customer segment assigned", "Low"),
    ("DQ10", "products", "Duplicate-like products (same name ignoring case/spaces)", "Medium"),
    ("DQ11", "products", "Products without a category", "High"),
    ("DQ12", "products", "Products without a supplier", "High"),
    ("DQ13", "products", "Products without a brand", "Low"),
    ("DQ14", "categories", "Category names that differ only by capitalisation", "High"),
    ("DQ15", "products", "Negative or zero price / cost (blocked by CHECK)", "High"),
    ("DQ16", "sales_order_items", "Quantity zero or negative (blocked by CHECK)", "High"),
    ("DQ17", "sales_order_items", "Unusually large quantity (25 or more units on one line)", "Medium"),
    ("DQ18", "sales_orders", "Order header total differs from the sum of its lines", "High"),
    ("DQ19", "multiple", "Orphan records (child rows without a parent)", "High"),
    ("DQ20", "multiple", "Impossible date order (order before registration, return before order, PO received before ordered)", "High"),
    ("DQ21", "sales_orders", "Completed orders with no payment record", "High"),
    ("DQ22", "sales_orders", "Completed orders where successful payments differ from the order total", "High"),
    ("DQ23", "inventory", "Stock on hand differs from the sum of the inventory ledger", "High"),
    ("DQ24", "inventory", "Positions with zero stock on hand", "Info"),
    ("DQ25", "products", "Inactive products that still hold stock", "Medium"),
    ("DQ26", "customers", "Customers flagged inactive who ordered in the last 90 days", "Medium"),
    ("DQ27", "suppliers", "Suppliers missing e-mail, phone or GSTIN", "Medium"),
    ("DQ28", "products", "Products never sold", "Info"),
    ("DQ29", "sales_orders", "Cancelled orders (kept in the data, excluded from KPIs)", "Info"),
    ("DQ30", "inventory_transactions", "Cancelled orders that moved stock (must be none)", "High"),
]


def bad_email(c: str = "email") -> Column:
    return F.col(c).isNotNull() & (~F.col(c).rlike(EMAIL_PATTERN) | (F.instr(c, "..") > 0))


def bad_phone(c: str = "phone") -> Column:
    return F.col(c).isNotNull() & ~F.regexp_replace(c, "[^0-9]", "").rlike(PHONE_PATTERN)


def folded(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def surplus_rows(df: DataFrame, key: Column, out: str) -> DataFrame:
    """Rows beyond the first of each key, counted as sum(count - 1)."""
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(out))


def rows_in(df: DataFrame, out: str) -> DataFrame:
    return df.agg(F.count("*").alias(out))


def ledger_balance(m: Retail) -> DataFrame:
    return m.inventory_transactions.groupBy("store_id", "product_id").agg(F.sum("quantity_change").alias("qty"))


def stock_against_ledger(m: Retail) -> DataFrame:
    held = m.inventory.join(ledger_balance(m), ["store_id", "product_id"], "left")
    return held.withColumn("ledger_stock", F.coalesce("qty", F.lit(0))).filter(F.col("quantity_on_hand") != F.col("ledger_stock"))


def order_book(m: Retail) -> DataFrame:
    """All counts that compare an order with its lines, payments and sale movements. These are summed per order and joined
    once on the order, which keeps orders without any and any without an order."""
    lines = m.sales_order_items.groupBy("order_id").agg(
        F.count("*").alias("line_rows"), F.sum("line_total").alias("line_sum"), F.count_if(F.col("quantity") <= 0).alias("none"),
        F.count_if(F.col("quantity") >= 25).alias("many"))
    paid = m.payments.groupBy("order_id").agg(
        F.count("*").alias("pay_rows"), F.sum(F.when(F.col("payment_status") == "SUCCESS", F.col("amount"))).alias("paid"))
    moved = m.inventory_transactions.filter(F.col("transaction_type") == "SALE").groupBy(F.col("reference_id").alias("order_id")).agg(
        F.count("*").alias("move_rows"))
    head = m.sales_orders.select("order_id", "total_amount", "order_status")
    book = head.join(lines, "order_id", "full_outer").join(paid, "order_id", "full_outer").join(moved, "order_id", "full_outer")
    known, done = F.col("order_status").isNotNull(), F.col("order_status") == "COMPLETED"

    def off(a: str, b: str, limit: float) -> Column:
        return F.abs(F.col(a) - F.col(b)).cast("double") > limit

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    def orphans(c: str) -> Column:
        return F.coalesce(F.sum(F.when(~known, F.col(c))), F.lit(0))

    return book.agg(
        total("line_rows").alias("lines"), total("none").alias("DQ16"), total("many").alias("DQ17"), total("pay_rows").alias("payments"),
        F.count_if(known).alias("orders"), F.count_if(done).alias("done"), F.count_if(F.col("order_status") == "CANCELLED").alias("DQ29"),
        F.count_if(off("total_amount", "line_sum", 0.05)).alias("DQ18"), F.count_if(done & F.col("pay_rows").isNull()).alias("DQ21"),
        F.count_if(done & off("total_amount", "paid", 0.01)).alias("DQ22"),
        orphans("line_rows").alias("orphan_lines"), orphans("pay_rows").alias("orphan_payments"), total("move_rows").alias("sale_moves"),
        F.coalesce(F.sum(F.when(F.col("order_status") == "CANCELLED", F.col("move_rows"))), F.lit(0)).alias("DQ30"))


def product_book(m: Retail) -> DataFrame:
    """All counts that compare a product with its stock and its lines. The three tables are stacked and counted by product, so
    each task sends one row per product and not its lines."""
    def part(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select(F.col("product_id").cast("bigint"), *[c.alias(n) for n, c in columns.items()])

    one, none = F.lit(1), F.lit(0)
    rows = stacked(
        part(m.products, product=one, inactive=F.when(~F.col("is_active"), 1).otherwise(0), position=none, empty=none, held=none, sold=none),
        part(m.inventory, product=none, inactive=none, position=one, empty=F.when(F.col("quantity_on_hand") == 0, 1).otherwise(0),
             held=F.when(F.col("quantity_on_hand") > 0, 1).otherwise(0), sold=none),
        part(m.sales_order_items, product=none, inactive=none, position=none, empty=none, held=none, sold=one))
    book = rows.groupBy("product_id").agg(*[F.sum(c).alias(c) for c in ("product", "inactive", "position", "empty")],
                                          *[F.max(c).alias(c) for c in ("held", "sold")])

    def total(c: str, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(c if where is None else F.when(where, F.col(c))), F.lit(0))

    return book.agg(
        total("position").alias("positions"), total("empty").alias("DQ24"), total("position", F.col("product") == 0).alias("orphan_stock"),
        total("inactive", F.col("held") == 1).alias("DQ25"), total("product", F.col("sold") == 0).alias("DQ28"))


def customer_book(m: Retail) -> DataFrame:
    """All counts that compare a customer with the dates of the orders, which are reduced to customer and day first."""
    days = m.sales_orders.groupBy("customer_id", F.col("order_date").cast("date").alias("day")).agg(
        F.count("*").alias("orders_of_day"), F.max("order_date").alias("latest"))
    known = days.join(m.customers.select("customer_id", "registration_date", "is_active"), "customer_id")
    people = known.groupBy("customer_id").agg(
        F.sum(F.when(F.col("day") < F.col("registration_date"), F.col("orders_of_day"))).alias("early"), F.max(F.when(~F.col("is_active"), F.col("latest"))).alias("latest"))
    since = m.sales_orders.agg(F.max("order_date")).scalar() - F.expr("INTERVAL 90 DAYS")
    return people.agg(F.coalesce(F.sum("early"), F.lit(0)).alias("early_orders"), F.count_if(F.col("latest") > since).alias("DQ26"))


def scorecard_counts(m: Retail, run_day: Column | None = None) -> DataFrame:
    """One row with the issue count of every check and the row totals: one aggregate per base table for all checks that
    look at single rows, one aggregate per check that needs a join or a grouping."""
    today = F.current_date() if run_day is None else run_day
    name, last = F.col("first_name"), F.col("last_name")
    sloppy = (name == F.upper(name)) | (name == F.lower(name)) | (name != F.trim(name)) | (last != F.trim(last))
    people = m.customers.agg(
        F.count("*").alias("customers"), F.count("email").alias("emails"), F.count("phone").alias("phones"),
        F.count("date_of_birth").alias("births"), F.count_if(~F.col("is_active")).alias("inactive_customers"),
        F.count_if(F.col("email").isNull()).alias("DQ02"), F.count_if(F.col("phone").isNull()).alias("DQ03"),
        F.count_if(bad_email()).alias("DQ04"), F.count_if(bad_phone()).alias("DQ05"),
        F.count_if((F.col("date_of_birth") < F.lit("1920-01-01").cast("date")) | (F.col("date_of_birth") > today)).alias("DQ06"),
        F.count_if(sloppy).alias("DQ07"), F.count_if(F.col("city").isNull()).alias("DQ08"),
        F.count_if(F.col("segment_id").isNull()).alias("DQ09"))
    goods = m.products.agg(
        F.count("*").alias("products"), F.count_if(~F.col("is_active")).alias("inactive_products"),
        F.count_if(F.col("category_id").isNull()).alias("DQ11"), F.count_if(F.col("supplier_id").isNull()).alias("DQ12"),
        F.count_if(F.col("brand").isNull()).alias("DQ13"), F.count_if((F.col("unit_price") <= 0) | (F.col("unit_cost") < 0)).alias("DQ15"))
    vendors = m.suppliers.agg(F.count("*").alias("suppliers"), F.count_if(
        F.col("contact_email").isNull() | F.col("contact_phone").isNull() | F.col("gstin").isNull()).alias("DQ27"))

    headers = m.sales_orders.select("order_id", "order_date")
    return one_row(
        people, goods, vendors, order_book(m), product_book(m), customer_book(m), rows_in(m.categories, "categories"),
        surplus_rows(m.customers.filter(F.col("email").isNotNull()), folded("email"), "DQ01"),
        surplus_rows(m.products, folded("product_name"), "DQ10"), surplus_rows(m.categories, F.lower("category_name"), "DQ14"),
        m.returns.select("order_id", "return_date").join(headers.withColumn("known", F.lit(True)), "order_id", "left").agg(
            F.count("*").alias("returns"), F.count_if(F.col("return_date") < F.col("order_date")).alias("early_returns"),
            F.count_if(F.col("known").isNull()).alias("orphan_returns")),
        m.purchases.agg(F.count("*").alias("purchases"), F.count_if(F.col("received_date") < F.col("order_date")).alias("early_receipts")),
        rows_in(stock_against_ledger(m), "DQ23"),
    ).withColumns({
        "DQ19": F.col("orphan_lines") + F.col("orphan_payments") + F.col("orphan_returns") + F.col("orphan_stock"),
        "DQ20": F.col("early_orders") + F.col("early_returns") + F.col("early_receipts"),
        "dq19_rows": F.col("lines") + F.col("payments") + F.col("returns") + F.col("positions"),
        "dq20_rows": F.col("orders") + F.col("returns") + F.col("purchases")})


SCORECARD_TOTALS = {
    "DQ04": "emails", "DQ05": "phones", "DQ06": "births", "DQ14": "categories", "DQ16": "lines", "DQ17": "lines", "DQ18": "orders",
    "DQ19": "dq19_rows", "DQ20": "dq20_rows", "DQ21": "done", "DQ22": "done", "DQ23": "positions", "DQ24": "positions",
    "DQ25": "inactive_products", "DQ26": "inactive_customers", "DQ27": "suppliers", "DQ29": "orders", "DQ30": "sale_moves"}


@query("Data-quality scorecard of thirty checks")
def q301_scorecard(m: Retail, run_day: Column | None = None) -> DataFrame:
    def line(check: str, table: str, name: str, severity: str) -> Column:
        total = SCORECARD_TOTALS.get(check, table)
        return F.struct(F.lit(check).alias("check_id"), F.lit(table).alias("table_name"), F.lit(name).alias("check_name"),
                        F.lit(severity).alias("severity"), F.col(check).alias("issue_count"), F.col(total).alias("total_rows"))

    rows = scorecard_counts(m, run_day).select(F.inline(F.array(*[line(*c) for c in CHECK_LIST])))
    status = F.when(F.col("issue_count") == 0, "PASS").when(F.col("severity") == "Info", "INFO").otherwise("ATTENTION")
    return rows.withColumns({"issue_pct": pct("issue_count", "total_rows", 2), "status": status}).orderBy("check_id")


@query("Members of the largest groups of customers with one e-mail")
def q302_duplicate_groups(m: Retail, n: int = 10) -> DataFrame:
    """One row per member; the n largest groups are chosen from counts first, and no group is gathered."""
    people = m.customers.filter(F.col("email").isNotNull()).select("customer_id", "first_name", folded("email").alias("normalised_email"))
    groups = people.groupBy("normalised_email").agg(F.count("*").alias("records")).filter(F.col("records") > 1)
    biggest = top(groups, n, F.col("records").desc(), F.col("normalised_email"))
    return people.join(biggest, "normalised_email").select("normalised_email", "records", "customer_id", "first_name").orderBy(
        F.col("records").desc(), "normalised_email", "customer_id")


@query("Products that share a name")
def q303_duplicate_products(m: Retail) -> DataFrame:
    """Every member of a name that repeats, with the size of its group and the group's first product: as many rows as products, where a list of
    pairs would grow with the square of a group."""
    goods = m.products.select(folded("product_name").alias("name_key"), "product_id", "sku", "product_name")
    groups = goods.groupBy("name_key").agg(F.count("*").alias("records"), F.min("product_id").alias("first_product")).filter(F.col("records") > 1)
    return goods.join(groups, "name_key").select("name_key", "records", "first_product", "product_id", "sku", "product_name").orderBy("first_product", "product_id")


@query("Missing values of the customer columns")
def q304_null_profile(m: Retail, columns: tuple[str, ...] = ("email", "phone", "gender", "date_of_birth", "city", "segment_id")) -> DataFrame:
    return null_profile(m.customers, columns).orderBy(F.col("null_pct").desc(), "column_name")


def null_profile(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """NULL count and percent of each column: one pass, then columns become rows."""
    names = columns or tuple(df.columns)
    counts = df.agg(F.count("*").alias("_rows"), *[(F.count("*") - F.count(c)).alias(c) for c in names])
    return counts.unpivot(["_rows"], list(names), "column_name", "null_count").select(
        "column_name", "null_count", pct("null_count", "_rows", 2).alias("null_pct"))


@query("Samples of invalid e-mails and phones")
def q305_invalid_contacts(m: Retail, n: int = 6) -> DataFrame:
    def sample(bad: Column, column: str, label: str) -> DataFrame:
        return top(m.customers.filter(bad).select(F.lit(label).alias("issue"), "customer_id", F.col(column).alias("value")), n, F.col("customer_id"))
    return stacked(sample(bad_email(), "email", "invalid e-mail"), sample(bad_phone(), "phone", "invalid phone"))


@query("Positions whose stock differs from the ledger")
def q306_ledger_mismatch(m: Retail, n: int = 15) -> DataFrame:
    gap = F.col("quantity_on_hand") - F.col("ledger_stock")
    named = stock_against_ledger(m).join(store_names(m), "store_id").withColumn("difference", gap)
    worst = top(named, n, F.abs("difference").desc(), F.col("store_name"), F.col("product_id"))
    return worst.join(m.products.select("product_id", "product_name"), "product_id").orderBy(
        F.abs("difference").desc(), "store_name", "product_id").select(
        "store_name", "product_name", F.col("quantity_on_hand").alias("recorded_stock"), "ledger_stock", "difference")


@query("Extreme order-line quantities")
def q307_extreme_quantities(m: Retail, n: int = 10) -> DataFrame:
    """The n lines are found first; means are then taken over all lines of their products only."""
    lines = m.keyed("sales_order_items").select("order_item_id", "order_id", "product_id", "quantity", "line_total")
    most = top(lines.join(m.sales_orders.select("order_id", "order_status"), "order_id"), n, F.col("quantity").desc(), F.col("order_id"),
               F.col("product_id"), F.col("line_total"))
    mean = lines.join(most.select("product_id"), "product_id", "left_semi").groupBy("product_id").agg(rnd(F.avg("quantity"), 1).alias("avg_qty_for_product"))
    return most.join(mean, "product_id").join(m.products.select("product_id", "product_name"), "product_id").orderBy(
        F.col("quantity").desc(), "order_id").select("order_item_id", "order_id", "product_name", "quantity", "avg_qty_for_product",
                                                     rnd("line_total", 0).alias("line_total"), "order_status")


@query("Completed orders without a payment, by store")
def q308_unpaid_by_store(m: Retail) -> DataFrame:
    free = completed(m).select("order_id", "store_id", "total_amount").join(m.payments.select("order_id"), "order_id", "left_anti")
    return free.groupBy("store_id").agg(F.count("*").alias("orders_without_payment"), rnd(F.sum("total_amount"), 0).alias("order_value")).join(
        store_names(m), "store_id").select("store_name", "orders_without_payment", "order_value").orderBy(F.col("orders_without_payment").desc())


@query("Category names that differ only by capitalisation")
def q309_category_variants(m: Retail) -> DataFrame:
    used = m.products.groupBy("category_id").agg(F.count("*").alias("n"))
    text = F.concat("category_name", F.lit(" (id "), "category_id", F.lit(", "), F.coalesce("n", F.lit(0)), F.lit(" products)"))
    named = m.categories.join(used, "category_id", "left").select(F.lower("category_name").alias("normalised_name"), "category_id", text.alias("t"))
    return named.groupBy("normalised_name").agg(F.expr("listagg(t, ' ; ') WITHIN GROUP (ORDER BY category_id)").alias("variants"),
                                                F.count("*").alias("c")).filter(F.col("c") > 1).drop("c")
