"""Physical layout of the tables: partitions for the filters the lookups use, order inside files for the rest.

A month of orders and lines, a store partition or an open-order status is skipped by its folder; a customer, product or day inside a file is skipped by
the minimum and maximum of its row groups. What an index was for one machine is here the way a table is written.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "stored_month"  # the folder of an order and its lines: yyyy-MM of the order's day

# table: (derived columns, partition columns, clustering columns)
LAYOUTS: dict[str, tuple[dict[str, str], list[str], list[str]]] = {
    "sales_orders": ({MONTH: "date_format(order_date, 'yyyy-MM')"}, [MONTH], ["customer_id", "order_date"]),
    "sales_order_items": ({}, [MONTH], ["product_id", "order_id"]),
    "payments": ({}, [], ["order_id"]),
    "returns": ({}, [], ["order_id"]),
    "return_items": ({}, [], ["order_item_id"]),
    "inventory": ({}, [], ["product_id", "store_id"]),
    "inventory_transactions": ({}, ["store_id"], ["product_id", "transaction_date"]),
    "purchases": ({}, ["status"], ["expected_date"]),
    "customers": ({"email_norm": "lower(email)"}, [], ["email_norm"]),
    "products": ({}, [], ["category_id", "product_id"]),
}


BUCKETED = {"sales_orders": "order_id", "sales_order_items": "order_id"}  # tables that may also be cut into buckets, and the key


def laid_out(df: DataFrame, table: str, files: int | None = None) -> DataFrame:
    """The table with its derived columns, range-partitioned over its keys. Partition columns come first in the order, so
    a month or store is written by a few neighbouring tasks, and a large one by as many as its share of the rows needs."""
    derived, parts, cluster = LAYOUTS.get(table, ({}, [], []))
    out = df.withColumns({name: F.expr(e) for name, e in derived.items()}) if derived else df
    keys = parts + cluster
    if not keys:
        return out
    spread = out.repartitionByRange(files, *keys) if files else out.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def write_table(df: DataFrame, path: str, table: str, files: int | None = None, mode: str = "error") -> None:
    parts = LAYOUTS.get(table, ({}, [], []))[1]
    writer = laid_out(df, table, files).write.mode(mode)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def fits_buckets(df: DataFrame, table: str, buckets: int) -> bool:
    """Whether no key has more rows than an even bucket: a bucket is read by one task, so a larger one would undo the even spread."""
    sizes = df.groupBy(BUCKETED[table]).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    return sizes.n is None or sizes.most * buckets <= sizes.n


def _table_name(path: str, table: str) -> str:
    """A name in the session's catalog that belongs to this path."""
    return f"{table}_{hashlib.md5(path.encode()).hexdigest()[:12]}"


def write_buckets(df: DataFrame, path: str, table: str, buckets: int) -> None:
    """The table by month and, in every month, by bucket of its key. Rows go to the task of their bucket, so a month has one file a bucket; joins
    on the key of two tables written so need no exchange, and a range of days still skips folders. The session's catalog gets an external table."""
    derived, parts, _ = LAYOUTS[table]
    key = BUCKETED[table]
    rows = df.withColumns({name: F.expr(e) for name, e in derived.items()}) if derived else df
    (rows.repartition(buckets, key).sortWithinPartitions(*parts, key).write.partitionBy(*parts).bucketBy(buckets, key).sortBy(key)
     .option("path", path).format("parquet").saveAsTable(_table_name(path, table)))


def open_buckets(spark: SparkSession, path: str, table: str, buckets: int) -> DataFrame:
    """The table at a path, with its buckets, also in a session that has not written it. Lines meet orders on the order and its month, of which the
    buckets hold the first; the session is told that such a part of a join's keys is enough (``spark.sql.requireAllClusterKeysForCoPartition``)."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = _table_name(path, table)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({', '.join(LAYOUTS[table][1])}) "
                  f"CLUSTERED BY ({BUCKETED[table]}) SORTED BY ({BUCKETED[table]}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
        try:
            spark.catalog.recoverPartitions(name)  # the catalog reads no folder that it does not list
        except Exception:
            spark.sql(f"DROP TABLE {name}")
            raise
    return spark.table(name)


def with_month_of_order(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with the month of their order, so that they are stored beside it; lines without an order get none."""
    return lines.join(orders.select("order_id", F.date_format("order_date", "yyyy-MM").alias(MONTH)), "order_id", "left")


def order_key(*tables: DataFrame) -> list[str]:
    """What joins lines to orders: the order, and the month where both are stored by it, so that a range of days skips folders on both sides."""
    return ["order_id", *([MONTH] if all(MONTH in t.columns for t in tables) else [])]


def since(orders: DataFrame, first: Column, day: str = "order_date") -> DataFrame:
    """Orders from a day on (included; it may be a scalar subquery). A table stored by month is read from that month's folder on."""
    rows = orders.filter(F.col(day) >= first)
    return rows.filter(F.col(MONTH) >= F.date_format(first, "yyyy-MM")) if MONTH in orders.columns else rows


def between_days(orders: DataFrame, first: Column, until: Column, day: str = "order_date") -> DataFrame:
    """Orders of first <= day < until; of a table stored by month only the folders of these months are read."""
    rows = since(orders, first, day).filter(F.col(day) < until)
    last = F.date_format(until.cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND"), "yyyy-MM")
    return rows.filter(F.col(MONTH) <= last) if MONTH in orders.columns else rows
