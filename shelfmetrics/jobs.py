"""Jobs: load the CSV extract, build the datasets, publish the star schema. Each output is one DataFrame write."""
from __future__ import annotations

import json
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from .plans import dataset
from .plans.datasets import DATASETS, asof_day, first_day
from .sources import Retail, build_calendar, read_records
from .sources.layout import BUCKETED, fits_buckets, with_month_of_order, write_buckets, write_table
from .sources.schemas import TABLES
from .sources.validate import validate, violation_counts

LOAD_ORDER = [t for t in TABLES if t != "dim_date"]


class RejectedLoad(ValueError):
    """Rows break a table constraint; the published tables are unchanged."""


def load(spark: SparkSession, source: str, target: str, version: str, check: bool = True,
         calendar: tuple[str, str] = ("2021-01-01", "2026-12-31"), keep_malformed: bool = False,
         buckets: int | None = None) -> str:
    """CSV extract -> validated Parquet under ``target/version``; parents before children. Files are parsed once, into ``target/_staged``;
    rules and layout read that. A version is written once: an existing one is refused. It is announced by a new file in
    ``target/_published`` after every table is written, so readers see the old load or the new one; a load that began before another one was
    announced is refused.

    Records that do not parse go, with their file and text, to ``target/_rejected/version``. They end the load after all tables are read, or with
    ``keep_malformed`` the others are loaded without them; ``malformed`` reads them.

    With ``buckets`` orders and lines are also cut into so many buckets of the order, and joined without an exchange. If one order has more lines
    than an even bucket would, both are stored by month alone."""
    place = last_published(spark, target) + 1
    root, staged = f"{target}/{version}", f"{target}/_staged/{version}"
    for table in LOAD_ORDER:
        read_records(spark, f"{source}/{table}.csv", table).write.mode("overwrite").parquet(f"{staged}/{table}")
    records = {t: spark.read.parquet(f"{staged}/{t}") for t in LOAD_ORDER}
    bad = [records[t].filter("record IS NOT NULL").select(F.lit(t).alias("table_name"), "file", "record") for t in LOAD_ORDER]
    reduce(DataFrame.unionByName, bad).write.mode("overwrite").parquet(f"{target}/_rejected/{version}")
    # One row per table and broken rule; both lists are fixed.
    broken = malformed(spark, target, version).groupBy("table_name").agg(F.lit("does not parse").alias("rule"), F.count("*").alias("rows"))
    if keep_malformed:
        broken = broken.limit(0)
    m = Retail(spark, {t: df.filter("record IS NULL").drop("record", "file") for t, df in records.items()})
    if check:
        broken = broken.unionByName(violation_counts(m, LOAD_ORDER))
    broken = broken.orderBy(F.col("rows").desc()).collect()
    if broken:
        raise RejectedLoad("; ".join(f"{r.table_name}: {r['rule']} ({r['rows']} rows)" for r in broken))
    if buckets and not all(fits_buckets(getattr(m, t), t, buckets) for t in BUCKETED):
        buckets = None
    for table in LOAD_ORDER:
        rows = getattr(m, table)
        rows = with_month_of_order(rows, m.sales_orders) if table == "sales_order_items" else rows
        if buckets and table in BUCKETED:
            write_buckets(rows, f"{root}/{table}", table, buckets)
        else:
            write_table(rows, f"{root}/{table}", table)
    build_calendar(spark, *calendar).coalesce(1).write.mode("error").parquet(f"{root}/dim_date")
    publish(spark, target, version, place, buckets)
    return root


def malformed(spark: SparkSession, target: str, version: str) -> DataFrame:
    """table_name, file, record: what did not parse in a load."""
    return spark.read.schema("table_name string, file string, record string").parquet(f"{target}/_rejected/{version}")


def _log(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_published")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def last_published(spark: SparkSession, target: str) -> int:
    """The number of the last announced load, 0 before the first."""
    path, fs = _log(spark, target)
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)


def publish(spark: SparkSession, target: str, version: str, place: int, buckets: int | None = None) -> None:
    """Announce a version at a place of the numbered log. The file is created only if it is absent, so of two writers that began at the same place one is
    refused, whatever their clocks say."""
    path, fs = _log(spark, target)
    entry = spark._jvm.org.apache.hadoop.fs.Path(path, f"{place:08d}.json")
    try:
        out = fs.create(entry, False)
    except Py4JJavaError as e:
        if not fs.exists(entry):
            raise
        raise RejectedLoad(f"another load was announced since {version} began") from e
    out.write(bytearray(json.dumps({"version": version, **({"buckets": buckets} if buckets else {})}).encode()))
    out.close()


def current(spark: SparkSession, target: str) -> Retail:
    """The model of the announced load: the greatest number in the log whose file has been written."""
    log = spark.read.schema("version string, buckets int").json(f"{target}/_published").filter("version IS NOT NULL")
    last = log.agg(F.max_by(F.struct("version", "buckets"), F.col("_metadata.file_name"))).first()[0]
    return Retail.from_parquet(spark, f"{target}/{last.version}", last.buckets)


def split_rejected(m: Retail, table: str, accepted: str, rejected: str) -> None:
    """Write the accepted and the rejected rows of one table apart."""
    good, bad = validate(m, table)
    good.write.mode("overwrite").parquet(accepted)
    bad.write.mode("overwrite").parquet(rejected)


def build(m: Retail, target: str, names: list[str] | None = None, **options: dict) -> None:
    """Materialise datasets, each from the tables alone. The customer summary must be unique by its key."""
    for name in names or list(DATASETS):
        out = dataset(m, name, **options.get(name, {}))
        out.write.mode("overwrite").parquet(f"{target}/{name}")
    if names is None or "vw_customer_summary" in names:
        stored = m.spark.read.parquet(f"{target}/vw_customer_summary")
        twice = stored.groupBy("customer_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        if not twice.isEmpty():
            raise ValueError("vw_customer_summary is not unique by customer_id")


def window_calendar(m: Retail) -> DataFrame:
    """The calendar limited to the data window."""
    return m.dim_date.filter(F.col("date_key").between(first_day(m), asof_day(m))).select(
        "date_key", "year", "quarter", "month", "month_name", "year_month", "week_of_year", "day_of_month", "day_of_week", "day_name", "is_weekend")


def store_dimension(m: Retail) -> DataFrame:
    return m.stores.select("store_id", "store_code", "store_name", "store_type", "city", "state", "region", "opened_date")


def customer_dimension(m: Retail) -> DataFrame:
    """Without the e-mail, which no report needs, and with the frequency band."""
    n = F.col("orders")
    label = (F.when(n == 0, "0 orders").when(n == 1, "1 order").when(n <= 3, "2-3 orders").when(n <= 6, "4-6 orders").when(n <= 12, "7-12 orders")
             .otherwise("13+ orders"))
    return dataset(m, "vw_customer_summary").drop("email").withColumn("frequency_band", label)


def category_dimension(m: Retail) -> DataFrame:
    return dataset(m, "vw_category_canonical").select("category_id", "canonical_id", "canonical_name", "parent_category")


def line_fact(m: Retail) -> DataFrame:
    promoted = F.when(F.col("promotion_id").isNull(), "Full price").otherwise("Promoted")
    return dataset(m, "vw_sales_lines").withColumn("promoted", promoted)


def stock_fact(m: Retail) -> DataFrame:
    days = F.col("days_since_restock")
    label = (F.when(days <= 30, "0-30").when(days <= 90, "31-90").when(days <= 180, "91-180").when(days <= 365, "181-365").when(days > 365, "365+"))
    return dataset(m, "vw_inventory_health").withColumn("stock_age", label)


# file: (frame, partition column or None, description)
EXPORTS = {
    "fact_sales_lines": (line_fact, "order_month", "Lines of completed orders with margin and promotion flag."),
    "fact_orders": (lambda m: dataset(m, "vw_orders"), "order_month", "Orders of any status with their money fields."),
    "fact_returns": (lambda m: dataset(m, "vw_return_analysis"), "return_month", "Returned units by line, with reason and delay."),
    "fact_inventory_health": (stock_fact, None, "Stock, demand and cover for each product at each store."),
    "dim_date": (window_calendar, None, "Days from the first to the last order."),
    "dim_store": (store_dimension, None, "Shops and the online hub."),
    "dim_product": (lambda m: dataset(m, "vw_product_performance"), None, "What each product sells, earns, returns and holds, with its class."),
    "dim_customer": (customer_dimension, None, "What each customer buys, how recently and how often."),
    "dim_category": (category_dimension, None, "Categories under one spelling."),
    "agg_monthly_sales": (lambda m: dataset(m, "vw_monthly_sales"), None, "Sales, margin and orders by month."),
    "agg_store_performance": (lambda m: dataset(m, "vw_store_performance"), None, "Sales, returns and stock by store."),
    "agg_category_performance": (lambda m: dataset(m, "vw_category_performance"), None, "Sales and margin by category and year."),
    "agg_supplier_performance": (lambda m: dataset(m, "vw_supplier_performance"), None, "Spend, punctuality and fill rate by supplier."),
}


def export_all(m: Retail, target: str, names: list[str] | None = None) -> DataFrame:
    """Write the star schema as CSV, facts partitioned by month, and return the manifest (file, rows, columns,
    description). Rows are observed while they are written, so nothing is read twice."""
    rows = []
    for name in names or list(EXPORTS):
        frame, part, text = EXPORTS[name]
        seen = Observation(name)
        df = frame(m)
        # A month goes to tasks by a range over month and a second column, so that a large month is spread. Rows are
        # observed after it, as placing a range samples the rows before it once more.
        out = (df.repartitionByRange(part, df.columns[0]) if part else df).observe(seen, F.count("*").alias("rows"))
        writer = out.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option(
            "timestampFormat", "yyyy-MM-dd HH:mm:ss").option("dateFormat", "yyyy-MM-dd")
        (writer.partitionBy(part) if part else writer).csv(f"{target}/{name}")
        rows.append((name, seen.get["rows"], len(df.columns), text))
    manifest = m.spark.createDataFrame(rows, "file string, rows long, columns int, description string")
    manifest.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{target}/_manifest")
    return manifest
