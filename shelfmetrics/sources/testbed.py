"""Adapter: the retail model over the driver's TPC-H-like Parquet tables.

Every retail table is a projection of one driver table (two for stores and the ledger), so that reading a model
table costs one scan: filters and column pruning still reach the Parquet reader, and no table needs a shuffle to exist.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import inline_rows, stacked
from .model import KEYED, Retail

# Fixed values of the adapter.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRODUCT_TYPES = ["LARGE", "ECONOMY", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CATEGORY_ROWS = [
    (1, "LARGE", 20), (2, "ECONOMY", 21), (3, "MEDIUM", 20), (4, "PROMO", 21), (5, "SMALL", 20), (6, "STANDARD", 20),
    (11, "economy", 21), (12, "Promo", 4), (20, "Core range", None), (21, "Value range", None), (30, "Seasonal", 21),
]
PROMOTION_ROWS = [
    (5, "SPRING96", "PERCENT", 5, "1996-03-01"), (6, "SPRING97", "PERCENT", 6, "1997-03-01"),
    (7, "SPRING98", "FLAT", 70, "1998-03-01"), (8, "SPRING99", "PERCENT", 8, "1999-03-01"),
    (9, "SPRING00", "FLAT", 90, "2000-03-01"), (10, "AUTUMN00", "PERCENT", 10, "2000-09-01"),
]
STORES = 25
POSITIONS_PER_PRODUCT = 4


# Schemas of the driver's tables, so that opening one runs no inference job (fixed values).
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
                " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _open(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW[name]).parquet(f"{sf_dir}/{name}.parquet")


def _name_list(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _cents(column: str) -> Column:
    """Whole cents of a positive amount."""
    return (F.col(column) * 100 + 0.5).cast("bigint")


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(14,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)")


def _fix(column: str, digits: int) -> Column:
    return F.col(column).cast(f"decimal({digits},2)")


def _hashed_store(key: str) -> Column:
    return (F.col(key) % 24 + 1).cast("int")


def testbed(spark: SparkSession, sf_dir: str) -> Retail:
    opened: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = _open(spark, sf_dir, name)
        return opened[name]

    def supplier_count() -> Column:
        return raw("supplier").agg(F.count("*")).scalar()

    def customer_segments() -> DataFrame:
        return inline_rows(spark, [(i + 1, n) for i, n in enumerate(SEGMENTS)], "segment_id int, segment_name string")

    def categories() -> DataFrame:
        return inline_rows(spark, CATEGORY_ROWS, "category_id int, category_name string, parent_category_id int").withColumn("is_active", F.lit(True))

    def suppliers() -> DataFrame:
        k = F.col("s_suppkey")
        return raw("supplier").select(
            k.alias("supplier_id"), F.col("s_name").alias("supplier_name"),
            F.when(k % 10 != 3, F.concat(F.lit("s"), k, F.lit("@example.com"))).alias("contact_email"),
            F.when(k % 10 != 4, F.concat(F.lit("+91 8"), F.lpad(k.cast("string"), 9, "0"))).alias("contact_phone"),
            F.concat(F.lit("City "), F.col("s_nationkey")).alias("city"),
            F.concat(F.lit("State "), F.col("s_nationkey") % 5).alias("state"),
            F.when(k % 15 != 7, F.concat(F.lit("GST"), k)).alias("gstin"),
            (k % 12 + 8).cast("int").alias("lead_time_days"), (k % 8 != 5).alias("is_active"))

    def products() -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size") % 4
        base = _cents("p_retailprice")
        price = (F.when(size == 0, F.floor(base / 2)).when(size == 1, base).when(size == 2, base * 4).otherwise(base * 12))
        cost = F.floor(price * (k % 30 + 55) / 100)
        typed = F.array_position(_name_list(PRODUCT_TYPES), F.col("p_type")).cast("int")
        slot = k % supplier_count()
        return raw("part").select(
            k.alias("product_id"), F.concat(F.lit("SKU-"), k).alias("sku"), F.col("p_name").alias("product_name"),
            F.when(k % 47 != 0, F.col("p_brand")).alias("brand"),
            F.when(k % 53 == 0, None).when((F.col("p_type") == "ECONOMY") & (k % 7 == 0), 11)
             .when((F.col("p_type") == "PROMO") & (k % 5 == 0), 12).otherwise(typed).alias("category_id"),
            F.when((k % 43 != 0) & (slot % 19 != 4), slot).alias("supplier_id"),
            _money(cost).alias("unit_cost"), _money(price).alias("unit_price"),
            F.when(size == 0, 5).when(size == 1, 12).when(size == 2, 18).otherwise(28).cast("decimal(4,2)").alias("gst_rate"),
            F.when(k % 61 != 0, F.date_add(F.lit("1993-06-01").cast("date"), (k * 7 % 2000).cast("int"))).alias("launch_date"),
            (k % 13 != 0).alias("is_active"))

    def stores() -> DataFrame:
        k = F.col("n_nationkey")
        return (raw("nation").join(raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            k.alias("store_id"), F.concat(F.lit("ST"), F.lpad(k.cast("string"), 2, "0")).alias("store_code"),
            F.col("n_name").alias("store_name"),
            F.when(k == 0, "ONLINE_WAREHOUSE").otherwise("STORE").alias("store_type"),
            F.concat(F.lit("City "), k).alias("city"),
            F.concat(F.lit("State "), F.col("n_regionkey"), F.lit("-"), k % 2).alias("state"),
            F.col("r_name").alias("region"),
            F.date_add(F.lit("1993-01-01").cast("date"), k * 61).alias("opened_date"), F.lit(True).alias("is_active")))

    def employees() -> DataFrame:
        k = F.col("s_suppkey")
        return raw("supplier").select(
            k.alias("employee_id"), F.lit("Staff").alias("first_name"), F.concat(F.lit("No "), k).alias("last_name"),
            (k % STORES).cast("int").alias("store_id"),
            F.when(k < STORES, None).when(k < 2 * STORES, k - STORES).otherwise(k % STORES + STORES).alias("manager_id"),
            F.when(k < STORES, "Store Manager").when(k < 2 * STORES, "Team Lead").otherwise("Sales Associate").alias("job_title"),
            F.date_add(F.lit("1988-01-01").cast("date"), (k * 7919 % 3000).cast("int")).alias("hire_date"),
            (k % 11 != 6).alias("is_active"))

    def customers() -> DataFrame:
        k = F.col("c_custkey")
        return raw("customer").select(
            k.alias("customer_id"),
            F.when(k % 31 == 0, "AMIT").when(k % 37 == 0, "neha ").otherwise("Customer").alias("first_name"),
            F.when(k % 41 != 0, F.substring("c_name", 10, 20)).alias("last_name"),
            F.when(k % 50 == 7, None).when(k % 50 == 8, F.concat(F.lit("user.."), k, F.lit("@example.com")))
             .when(k % 50 == 9, F.concat(F.lit(" USER"), k - 3, F.lit("@Example.com ")))
             .otherwise(F.concat(F.lit("user"), k, F.lit("@example.com"))).alias("email"),
            F.when(k % 60 == 11, None).when(k % 60 == 12, "12345")
             .otherwise(F.concat(F.lit("+91 9"), F.lpad((k % 1000000000).cast("string"), 9, "0"))).alias("phone"),
            F.when(k % 3 == 0, "F").when(k % 3 == 1, "M").alias("gender"),
            F.when(k % 70 == 13, F.lit("1900-01-01").cast("date"))
             .when(k % 70 != 14, F.date_add(F.lit("1950-01-01").cast("date"), (k % 18000).cast("int"))).alias("date_of_birth"),
            F.when(k % 45 != 5, F.concat(F.lit("City "), F.col("c_nationkey"))).alias("city"),
            F.concat(F.lit("State "), F.col("c_nationkey") % 5).alias("state"),
            F.when(k % 40 != 0, F.array_position(_name_list(SEGMENTS), F.col("c_mktsegment")).cast("int")).alias("segment_id"),
            F.date_add(F.lit("1994-01-01").cast("date"), (k * 37 % 1200).cast("int")).alias("registration_date"),
            (k % 9 != 0).alias("is_active"))

    def promotions() -> DataFrame:
        rows = inline_rows(spark, PROMOTION_ROWS, "promotion_id int, promo_code string, discount_type string, v int, s string")
        start = F.col("s").cast("date")
        return rows.select("promotion_id", "promo_code", F.col("promo_code").alias("promo_name"), "discount_type",
                           F.col("v").cast("decimal(10,2)").alias("discount_value"), start.alias("start_date"),
                           F.date_add(start, 29).alias("end_date"), F.lit(True).alias("is_active"))

    def product_promotions() -> DataFrame:
        k = F.col("p_partkey")
        return raw("part").filter(k % 11 <= 5).select((k % 11 + 5).cast("int").alias("promotion_id"), k.alias("product_id"))

    online = F.col("o_orderpriority") == "1-URGENT"

    def order_columns() -> list[Column]:
        k, total = F.col("o_orderkey"), _fix("o_totalprice", 12)
        gst = total * F.lit("0.15").cast("decimal(2,2)")
        discount = F.when(k % 4 == 0, total * F.lit("0.05").cast("decimal(2,2)")).otherwise(F.lit(0).cast("decimal(14,4)"))
        return [
            k.alias("order_id"), F.concat(F.lit("SO-"), k).alias("order_number"), F.col("o_custkey").alias("customer_id"),
            F.when(online, 0).otherwise(_hashed_store("o_orderkey")).alias("store_id"),
            F.when(~online, k % 24 + 1 + F.floor(k / 24) % 3 * STORES).alias("employee_id"),
            F.col("o_orderdate").alias("order_date"),
            F.when(online, "ONLINE").otherwise("IN_STORE").alias("channel"),
            F.when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("COMPLETED").alias("order_status"),
            (total - gst + discount).alias("subtotal"), discount.alias("discount_amount"),
            gst.alias("gst_amount"), total.alias("total_amount")]

    def sales_orders() -> DataFrame:
        return raw("orders").select(*order_columns())

    # A line has no key in the data: its place in its file is one, and needs no shuffle to be known. A scan that knows
    # places builds them for every row, so tables are offered without the key and, under KEYED, with it.
    line_id = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index"))
    units = F.col("l_quantity").cast("int")
    gross, rate = _fix("l_extendedprice", 12), _fix("l_discount", 4)
    price_cents = F.call_function("div", _cents("l_extendedprice") * 2 + units, units.cast("bigint") * 2)
    cost_cents = F.call_function("div", price_cents * (F.col("l_partkey") % 30 + 55), F.lit(100).cast("bigint"))
    line_total = gross * (F.lit(1).cast("decimal(1,0)") - rate)

    def sales_order_items(*key: Column) -> DataFrame:
        return raw("lineitem").select(
            *key, F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.when(F.col("l_discount") >= 0.05, F.round(F.col("l_discount") * 100).cast("int")).alias("promotion_id"),
            units.alias("quantity"), _money(price_cents).alias("unit_price"), _money(cost_cents).alias("unit_cost"),
            (gross * rate).alias("discount_amount"), line_total.alias("line_total"),
            (_fix("l_tax", 4) * 100).cast("decimal(4,2)").alias("gst_rate"))

    def payments() -> DataFrame:
        k, total = F.col("o_orderkey"), _fix("o_totalprice", 12)
        p = F.substring("o_orderpriority", 1, 1)
        return raw("orders").filter(k % 20 != 1).select(
            k.alias("payment_id"), k.alias("order_id"), F.col("o_orderdate").alias("payment_date"),
            F.when(p == "1", "UPI").when(p == "2", "CARD").when(p == "3", "CASH").when(p == "4", "NET_BANKING")
             .otherwise("WALLET").alias("payment_method"),
            F.when(k % 500 == 3, total - 1).otherwise(total).cast("decimal(12,2)").alias("amount"),
            F.when(k % 20 == 0, "FAILED").when(k % 33 == 5, "REFUNDED").otherwise("SUCCESS").alias("payment_status"),
            F.concat(F.lit("T"), k).alias("transaction_ref"))

    def returned_lines() -> DataFrame:
        return raw("lineitem").filter(F.col("l_returnflag") == "R")

    def returns(*key: Column) -> DataFrame:
        r = F.col("l_linenumber") % 4
        return returned_lines().select(
            *key, F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("return_date"),
            F.when(r == 0, "DEFECTIVE").when(r == 1, "WRONG_ITEM").when(r == 2, "NOT_AS_DESCRIBED")
             .otherwise("CHANGED_MIND").alias("return_reason"),
            line_total.alias("refund_amount"), F.lit(None).cast("bigint").alias("processed_by"))

    def return_items(*keys: Column) -> DataFrame:
        return returned_lines().select(
            *keys, units.alias("quantity"), line_total.alias("refund_amount"), (F.col("l_linestatus") == "O").alias("restocked"))

    def inventory() -> DataFrame:
        k, s = F.col("product_id"), F.col("store_id")
        placed = raw("part").select(
            F.col("p_partkey").alias("product_id"), F.explode(F.sequence(F.lit(0), F.lit(POSITIONS_PER_PRODUCT - 1))).alias("i"),
        ).withColumn("store_id", ((k * 7 + F.col("i") * 6) % STORES).cast("int"))
        stocked = placed.withColumn("on_hand", F.greatest((k * 7 + s * 13) % 120 - 8, F.lit(0)))
        return stocked.select(
            (k * POSITIONS_PER_PRODUCT + F.col("i")).alias("inventory_id"), "store_id", "product_id",
            F.col("on_hand").alias("quantity_on_hand"), F.floor(F.col("on_hand") / 10).alias("reserved_quantity"),
            (k % 20 + 10).alias("reorder_level"), (k % 40 + 60).alias("max_stock_level"),
            F.when(k % 29 != 0, F.date_sub(F.lit("2001-08-01").cast("date"), ((k * 11 + s * 17) % 500).cast("int")))
             .alias("last_restocked_date"))

    def purchase_columns() -> list[Column]:
        k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        supplier = k % supplier_count()
        lead = (supplier % 12 + 8).cast("int")
        received = F.col("o_orderstatus") != "P"
        return [
            k.alias("purchase_id"), F.concat(F.lit("PO-"), k).alias("po_number"), supplier.alias("supplier_id"),
            (k % STORES).cast("int").alias("store_id"), day.alias("order_date"), F.date_add(day, lead).alias("expected_date"),
            F.when(received, F.date_add(day, lead - 4 + (F.col("o_custkey") % 9).cast("int"))).alias("received_date"),
            F.when(received, "RECEIVED").otherwise("ORDERED").alias("status"), _fix("o_totalprice", 12).alias("total_amount")]

    def purchases() -> DataFrame:
        return raw("orders").select(*purchase_columns())

    units_received = F.when(F.col("l_linenumber") == 1, units - 1).otherwise(units)

    def purchase_items(*key: Column) -> DataFrame:
        return raw("lineitem").select(
            *key, F.col("l_orderkey").alias("purchase_id"), F.col("l_partkey").alias("product_id"),
            units.alias("quantity_ordered"), units_received.alias("quantity_received"),
            _money(cost_cents).alias("unit_cost"))

    item_key, return_key, po_key = line_id.alias("order_item_id"), line_id.alias("return_id"), line_id.alias("purchase_item_id")
    return_keys = (line_id.alias("return_item_id"), return_key, item_key)

    def entry(kind: str, change: Column, when: Column, ref_type: str | None, ref: Column, key: Column | None = None) -> list[Column]:
        return [
            *([F.concat(F.lit(kind[:3]), key).alias("transaction_id")] if key is not None else []), F.lit(kind).alias("transaction_type"),
            change.cast("bigint").alias("quantity_change"), when.cast("timestamp_ntz").alias("transaction_date"),
            F.lit(ref_type).alias("reference_type"), ref.cast("bigint").alias("reference_id")]

    def stock_entries(with_key: bool) -> list[DataFrame]:
        stock, none, key = inventory(), F.lit(None), F.col("inventory_id") if with_key else None
        return [
            stock.select("store_id", "product_id", *entry("OPENING", F.lit(500), F.lit("1995-01-01").cast("date"), None, none, key)),
            stock.filter("quantity_on_hand % 10 = 3").select(
                "store_id", "product_id", *entry("ADJUSTMENT", F.lit(-2), F.lit("2001-06-30").cast("date"), None, none, key))]

    def inventory_transactions() -> DataFrame:
        orders = sales_orders().select("order_id", "store_id", "order_date", "order_status")
        sold = sales_order_items().join(orders.filter(F.col("order_status") == "COMPLETED"), "order_id")
        back = returned_lines().filter(F.col("l_linestatus") == "O").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            units.alias("quantity"), F.col("l_shipdate").alias("return_date")).join(orders, "order_id")
        bought = purchase_items().join(purchases().filter(F.col("status") == "RECEIVED"), "purchase_id")
        return stacked(*stock_entries(False), *[df.select("store_id", "product_id", *columns) for df, columns in (
            (sold, entry("SALE", -F.col("quantity"), F.col("order_date"), "ORDER", F.col("order_id"))),
            (back, entry("RETURN", F.col("quantity"), F.col("return_date"), "RETURN", F.col("order_id"))),
            (bought, entry("PURCHASE", F.col("quantity_received"), F.col("received_date"), "PURCHASE", F.col("purchase_id"))))])

    def keyed_transactions() -> DataFrame:
        """The same with the key. Who asks for it reads whole movements, so a line meets its order once for its sale, return and purchase."""
        order, purchase = F.struct(*order_columns()).alias("o"), F.struct(*purchase_columns()).alias("p")
        heads = raw("orders").select(order, purchase).select(
            "o.order_id", F.col("o.store_id").alias("sold_by"), "o.order_date", (F.col("o.order_status") == "COMPLETED").alias("completed"),
            F.col("p.store_id").alias("bought_by"), "p.received_date", (F.col("p.status") == "RECEIVED").alias("received"))
        back = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
        lines = raw("lineitem").select(
            item_key, F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), units.alias("quantity"),
            units_received.alias("quantity_received"), back.alias("back"), F.when(back, F.col("l_shipdate")).alias("return_date"))

        def when(happened: str, store: str, *rest) -> Column:
            return F.when(F.col(happened), F.struct(F.col(store).alias("store_id"), *entry(*rest, F.col("order_id"), F.col("order_item_id"))))

        moved = F.array(
            when("completed", "sold_by", "SALE", -F.col("quantity"), F.col("order_date"), "ORDER"),
            when("back", "sold_by", "RETURN", F.col("quantity"), F.col("return_date"), "RETURN"),
            when("received", "bought_by", "PURCHASE", F.col("quantity_received"), F.col("received_date"), "PURCHASE"))
        of_lines = lines.join(heads, "order_id").select("product_id", F.inline(moved)).filter(F.col("transaction_type").isNotNull())
        return stacked(*stock_entries(True), of_lines)

    def calendar() -> DataFrame:
        from .calendar import build_calendar
        return build_calendar(spark, "1995-01-01", "2001-12-31")

    return Retail(spark, {
        "dim_date": calendar, "customer_segments": customer_segments, "categories": categories, "suppliers": suppliers,
        "products": products, "stores": stores, "employees": employees, "customers": customers, "promotions": promotions,
        "product_promotions": product_promotions, "sales_orders": sales_orders, "sales_order_items": sales_order_items,
        "payments": payments, "returns": returns, "return_items": return_items, "inventory": inventory,
        "inventory_transactions": inventory_transactions, "purchases": purchases, "purchase_items": purchase_items,
        "sales_order_items" + KEYED: lambda: sales_order_items(item_key), "returns" + KEYED: lambda: returns(return_key),
        "return_items" + KEYED: lambda: return_items(*return_keys), "purchase_items" + KEYED: lambda: purchase_items(po_key),
        "inventory_transactions" + KEYED: keyed_transactions})


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as completed orders: the only driver table with a real time of day."""
    amount = _fix("value", 12)
    return (_open(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"),
        _hashed_store("user_id").alias("store_id"), F.col("ts").alias("order_date"),
        F.lit("IN_STORE").alias("channel"), F.lit("COMPLETED").alias("order_status"),
        (amount * F.lit("0.15").cast("decimal(2,2)")).alias("gst_amount"), amount.alias("total_amount")))
