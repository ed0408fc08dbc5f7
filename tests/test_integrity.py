"""What integrity rules shuffle and store, and their counts by bits of keys and by joins."""
import re

import pytest
from pyspark.sql import functions as F

import shelfmetrics.plans.integrity as integrity
from shelfmetrics.operators import KNOWN, key_bits, marked
from shelfmetrics.plans.integrity import ALL_RULES, integrity_report, line_rules, running_balances, with_eligible

SLIM = [r for r in ALL_RULES if r != "running ledger balance >= 0"]


def counts(df):
    return {r.rule: r.violations for r in df.collect()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def shuffled(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_lines_are_not_shuffled_by_product_or_promotion(spark, model, shuffled):
    """Only what an order has to judge is shuffled, with the dates of returns; the six promotions are broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 500)
    text = shuffled(line_rules(model))
    assert set(re.findall(r"hashpartitioning[(](\w+)#", text)) == {"order_id"}
    assert len(re.findall(r"FileScan parquet[^\n]*orders[.]parquet", text)) == 1


def test_the_ledger_is_not_stored(micro, monkeypatch):
    """Movements with their keys are shuffled by position once; what is kept is one row."""
    def never(df):
        raise AssertionError("a frame was checkpointed")
    stored, keep = [], integrity.stored_columns
    monkeypatch.setattr(integrity, "cut_lineage", never)
    monkeypatch.setattr(integrity, "stored_columns", lambda df: (stored.append(df), keep(df))[1])
    assert counts(integrity_report(micro))["running ledger balance >= 0"] == 1
    assert [df.count() for df in stored] == [1]


def test_movements_are_not_shuffled_to_find_large_positions(model, shuffled):
    text = shuffled(running_balances(integrity.ledger(model, keyed=True))[0])
    assert len(re.findall(r"hashpartitioning[(]store_id#\d+, product_id#", text)) == 1


def test_a_line_meets_its_order_once_for_its_movements(model, shuffled):
    text = shuffled(model.keyed("inventory_transactions"))
    assert len(re.findall(r"FileScan parquet[^\n]*lineitem[.]parquet", text)) == 1 and len(re.findall(r"hashpartitioning[(]order_id#", text)) == 2


def test_keyed_movements_are_those_without_key(model):
    plain, keyed = model.inventory_transactions, model.keyed("inventory_transactions")
    names = plain.columns
    assert {f.name: f.dataType for f in plain.schema} == {f.name: f.dataType for f in keyed.schema if f.name != "transaction_id"}
    assert plain.exceptAll(keyed.select(*names)).isEmpty() and keyed.select(*names).exceptAll(plain).isEmpty()
    assert keyed.filter("transaction_type in ('SALE', 'RETURN', 'PURCHASE')").groupBy("transaction_id").count().filter("count > 1").isEmpty()
    assert keyed.filter("left(transaction_id, 3) <> left(transaction_type, 3) or transaction_id is null").isEmpty()


def odd_models(micro):
    """Unknown products, promotions and orders, keys that are null; a repeated order and product, for which there are no bits."""
    lines = micro.sales_order_items.withColumn("gst_rate", F.lit(18).cast("decimal(4,2)"))
    moves = micro.inventory_transactions
    odd = lines.withColumns({
        "product_id": F.when(F.col("order_item_id") % 3 == 0, 77).when(F.col("order_item_id") != 4, F.col("product_id")),
        "promotion_id": F.when(F.col("order_item_id") % 2 == 0, 1).when(F.col("order_item_id") == 5, 9),
        "order_id": F.when(F.col("order_item_id") != 6, F.col("order_id")), "line_total": F.col("line_total") + F.col("order_item_id") % 2})
    lost = moves.withColumn("reference_id", F.when(F.col("transaction_id") == 2, 5).when(F.col("transaction_id") == 3, 99).cast("bigint"))
    yield micro.with_tables(sales_order_items=odd.unionByName(lines), inventory_transactions=lost.unionByName(lost))
    yield micro.with_tables(sales_order_items=odd, sales_orders=micro.sales_orders.unionByName(micro.sales_orders.limit(1)),
                            inventory_transactions=lost, product_promotions=micro.product_promotions.filter("false"))


def test_counts_by_bits_are_those_by_joins(micro, monkeypatch):
    made, kept = [], integrity.key_bits
    for m in odd_models(micro):
        monkeypatch.setattr(integrity, "key_bits", lambda *a: (made.append(kept(*a)), made[-1])[1])
        by_bits = counts(integrity_report(m, SLIM))
        monkeypatch.setattr(integrity, "key_bits", lambda *a: None)
        assert by_bits == counts(integrity_report(m, SLIM))
        assert by_bits["sale movement refers to an order"] and by_bits["line refers to a product"] and by_bits["promotion on an eligible product"]
    assert any(made) and None in made


def test_marked_rows_are_those_of_a_left_join(spark):
    keys = spark.createDataFrame([(k, k % 2) for k in (-4097, -1, 0, 5, 4096)], "k bigint, c int")
    facts = spark.createDataFrame([(k, n) for n in range(2) for k in (-4097, -2, -1, 0, 5, 6, 4096, 1 << 40, None)], "f bigint, n int")
    met = facts.join(keys, F.col("f") == F.col("k"), "left").select("f", "n", F.col("k").isNotNull().alias("a"), F.coalesce(F.col("c") == 1, F.lit(False)).alias("b"))
    assert rows(marked(facts, "f", key_bits(keys, "k", {"one": F.col("c") == 1}), {"a": KNOWN, "b": "one"})) == rows(met)


def test_pairs_far_from_each_other_meet_by_a_join(spark, micro):
    """Numbers of pairs neither collide nor overflow."""
    far = (1 << 62) + 1
    pairs = spark.createDataFrame([(1, 2), (3, 1), (2, 4)], "promotion_id int, product_id bigint")
    lines = spark.createDataFrame([(a, b) for a in (0, 1, 2, 3, 4, None) for b in (-far, 0, 1, 2, 3, 4, 5, far, None)], "promotion_id int, product_id bigint")
    for more in ([], [(1, far)], [(1 << 30, 1)]):
        known = pairs.union(spark.createDataFrame(more, pairs.schema)) if more else pairs
        found = with_eligible(micro.with_tables(product_promotions=known), lines).filter("eligible").select("promotion_id", "product_id")
        assert rows(found) == rows(lines.join(known, ["promotion_id", "product_id"], "left_semi"))
