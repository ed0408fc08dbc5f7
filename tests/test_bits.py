"""Flags of whole-number keys as bits, and the measures that read orders through them."""
import pytest
from pyspark.sql import functions as F

import shelfmetrics.plans.measures as measure_layer
from shelfmetrics.operators import KNOWN, flagged, key_bits
from shelfmetrics.plans.measures import measures

NAMES = ["net_revenue", "gross_profit", "units_sold", "orders_line_basis", "cogs_last_12m", "cogs_last_365d", "class_a_products", "units_returned",
         "refunded_net_of_gst", "write_off_cost", "dead_stock_positions", "low_stock_positions", "suggested_order_qty"]
KEYS = [-4097, -4096, -65, -64, -1, 0, 1, 63, 64, 4095, 4096, 100_000, None]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_flagged_rows_are_those_of_the_join(spark, kind):
    keys = spark.createDataFrame([(k, i % 3) for i, k in enumerate(KEYS)], f"k {kind}, c int")
    facts = spark.createDataFrame([(k, n) for n in range(2) for k in [*KEYS, 2, 62, 65, 4097, -2, 1 << 20]], f"f {kind}, n int")
    bits = key_bits(keys, "k", {"one": F.col("c") == 1, "some": F.col("c") > 0})
    for only, where in ((KNOWN, "true"), ("one", "c = 1"), ("some", "c > 0")):
        met = facts.join(keys.filter(where), F.col("f") == F.col("k")).select("f", "n", (F.col("c") == 1).alias("one"))
        assert rows(flagged(facts, "f", bits, only, "one")) == rows(met)


@pytest.mark.parametrize("keys", [[("a",)], [(1,), (1,)], [(0,), (1 << 62,)], [(-(1 << 63),), ((1 << 63) - 1,)], [(None,)]])
def test_keys_without_bits(spark, keys):
    """Strings, repeated keys, keys far apart, none at all: the caller joins the tables."""
    kind = "string" if keys == [("a",)] else "bigint"
    assert key_bits(spark.createDataFrame(keys, f"k {kind}"), "k", {}) is None


def test_bits_have_a_limit(spark):
    keys = spark.range(0, 1 << 20, 1 << 12)
    assert key_bits(keys, "id", {"even": F.col("id") % 2 == 0}, limit_mb=0.2) is None and key_bits(keys, "id", {"even": F.col("id") % 2 == 0}, limit_mb=0.25)


def odd_models(micro):
    """Lines and returns without an order or of unknown ones; a repeated order, for which there are no bits."""
    orders, lines, returns = micro.sales_orders, micro.sales_order_items, micro.returns
    lost = F.when(F.col("order_id") % 3 != 0, F.col("order_id")).alias("order_id")
    yield micro.with_tables(sales_orders=orders.filter("order_id % 5 != 0"), sales_order_items=lines.withColumn("order_id", lost),
                            returns=returns.withColumn("order_id", lost))
    yield micro.with_tables(sales_orders=orders.unionByName(orders.limit(1)), **{n: t.withColumn("order_id", F.col("order_id").cast("bigint")) for n, t in (
        ("sales_order_items", lines), ("returns", returns))})


@pytest.mark.parametrize("keys", [[], ["category"]])
def test_measures_by_bits_are_those_by_joins(micro, monkeypatch, keys):
    kept = measure_layer._order_bits
    for m in odd_models(micro):
        monkeypatch.setattr(measure_layer, "_order_bits", kept)
        by_bits = measures(m, NAMES, keys)
        monkeypatch.setattr(measure_layer, "_order_bits", lambda *a: None)
        by_joins = measures(m, NAMES, keys)
        assert by_bits.dtypes == by_joins.dtypes
        for a, b in zip(rows(by_bits), rows(by_joins), strict=True):
            assert [float(x) if isinstance(x, (int, float)) else x for x in a] == [
                pytest.approx(float(x), rel=1e-9) if isinstance(x, (int, float)) else x for x in b]


@pytest.mark.parametrize("keys", [[], ["category"]])
def test_sums_and_returns_meet_no_orders(model, keys):
    text = measures(model, ["net_revenue", "orders_line_basis", "class_a_products", "units_returned"], keys)._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in text


def test_lines_are_not_shuffled_by_order(spark, model, monkeypatch):
    """What is stored for the sums of a category: lines lie by product, only what counts orders by order."""
    stored, keep = [], measure_layer.stored_columns
    monkeypatch.setattr(measure_layer, "stored_columns", lambda df: (stored.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        measures(model, ["net_revenue", "orders_line_basis", "class_a_products"], ["category"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert stored and "hashpartitioning(product_id#" in stored[0] and not any("hashpartitioning(order_id#" in text for text in stored)
