"""Own operators against plain windows, built-in aggregates and brute force, on skewed and tied data."""
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmetrics.functions import band, pct, rnd
from shelfmetrics.operators import (abc_classes, consecutive_runs, descend, gap_days, not_in, pair_counts, percent_ranks, percentiles, quantile_buckets,
                                    running_totals)
from shelfmetrics.operators.ordering import attach_rank


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows hold one value, one group holds a third of the rows, one group has a single row, some values are NULL."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(5)}"
        v = 0.0 if i % 3 == 1 else None if i % 50 == 0 else round(rng.random() * 100, 2)
        rows.append((i, g, v))
    rows.append((3000, "alone", 5.0))
    return spark.createDataFrame(rows, "id int, g string, v double").cache()


def order():
    return [F.col("v").asc_nulls_last(), F.col("id").asc()]


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals_equal_the_window(skewed, by):
    w = Window.partitionBy(*by).orderBy(*order())
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    mine = running_totals(skewed, order(), ["v"], by).select("id", "row_no", "row_count", F.round("run_v", 6), F.round("all_v", 6))
    plain = skewed.select("id", F.row_number().over(w).cast("bigint"), F.count("*").over(Window.partitionBy(*by)),
                          F.round(F.sum("v").over(rows), 6), F.round(F.sum("v").over(Window.partitionBy(*by)), 6))
    same(mine, plain)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("n", [5, 10, 4000])
def test_buckets_equal_ntile(skewed, by, n):
    same(quantile_buckets(skewed, n, order(), "q", by).select("id", "q"),
         skewed.select("id", F.ntile(n).over(Window.partitionBy(*by).orderBy(*order()))))


def test_ranks_equal_the_window_with_ties(skewed):
    known = skewed.filter("v is not null")
    w = Window.partitionBy("g").orderBy("v")
    same(percent_ranks(known, "v", "p", ["g"]).select("id", F.round("p", 9)), known.select("id", F.round(F.percent_rank().over(w), 9)))
    same(attach_rank(known, "v", "r", ["g"]).select("id", "r"),
         known.select("id", F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc())).cast("bigint")))


def test_percentiles_equal_the_exact_aggregate(skewed):
    mine = percentiles(skewed, "v", {"a": 0.25, "b": 0.5, "c": 0.99}, ["g"]).select("g", *[F.round(c, 9) for c in "abc"])
    same(mine, skewed.groupBy("g").agg(*[F.round(F.percentile("v", p), 9) for p in (0.25, 0.5, 0.99)]))
    weighted = skewed.groupBy("v").agg(F.count("*").alias("n"))
    assert percentiles(weighted, "v", {"m": 0.5}, weight="n").first().m == skewed.agg(F.percentile("v", 0.5)).first()[0]


def test_abc_series(spark):
    series = spark.createDataFrame([(i, float(v)) for i, v in enumerate([50, 30, 10, 5, 3, 2])], "k int, v double")
    classes = {r.v: r.abc_class for r in abc_classes(series, "v", "k").collect()}
    assert classes == {50: "A", 30: "A", 10: "B", 5: "B", 3: "C", 2: "C"}


def test_gap_days_counts_repeated_days(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', DATE'2024-01-01'), ('a', DATE'2024-01-01'), ('a', DATE'2024-01-01'), ('a', DATE'2024-01-11'),"
                   " ('b', DATE'2024-02-01') AS t(k, d)")
    gaps = {(r.k, r.gap_days): r.events for r in gap_days(df, "k", "d").collect()}
    assert gaps == {("a", 0): 2, ("a", 10): 1}


def test_consecutive_runs(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 3, 7, 8)] + [("b", 5)], "k string, s int")
    assert {tuple(r) for r in consecutive_runs(df, "k", "s").collect()} == {("a", 1, 3, 3), ("a", 7, 8, 2), ("b", 5, 5, 1)}


def test_hierarchy_paths_and_cycle(spark):
    tree = spark.createDataFrame([(1, None, "A"), (2, 1, "B"), (3, 2, "C"), (9, None, "Z")], "k int, p int, n string")
    assert {(r.k, r.root, r.depth, r.path) for r in descend(tree, "k", "p", "n").collect()} == {
        (1, 1, 1, "A"), (2, 1, 2, "A > B"), (3, 1, 3, "A > B > C"), (9, 9, 1, "Z")}
    deep = spark.range(1, 61).selectExpr("id AS k", "nullif(id - 1, 0) AS p", "cast(id AS string) AS n")
    assert descend(deep, "k", "p", "n").agg(F.max("depth"), F.count("*")).first()[:] == (60, 60)
    with pytest.raises(ValueError):
        descend(tree.union(spark.createDataFrame([(2, 3, "B")], tree.schema)), "k", "p", "n")


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pair_counts_equal_brute_force(spark, block):
    """Also with blocks far smaller than the large basket, and with repeated items and labels."""
    rng = random.Random(3)
    rows = [(b, i, f"n{i % 4}") for b in range(20) for i in [rng.randrange(8) for _ in range(rng.randrange(1, 6))]]
    rows += [(99, i % 30, f"n{i % 4}") for i in range(40)]
    expected = Counter()
    for _, lines in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        lines = list(lines)
        expected.update((a[2], b[2]) for a in lines for b in lines if a[1] < b[1])
    df = spark.createDataFrame(rows, "b int, i int, n string")
    got = {(r.label_a, r.label_b): r.together for r in pair_counts(df, "b", "i", "n", block).collect()}
    assert got == dict(expected)


def test_pairs_of_lines_without_a_basket_are_none(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 1, "a"), (1, 2, "b"), (1, None, "c")], "b int, i int, n string")
    assert [tuple(r) for r in pair_counts(df, "b", "i", "n").collect()] == [("a", "b", 1)]


def test_not_in_three_valued(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert not_in(left, spark.createDataFrame([(1,)], "k int"), "k").collect() == [(2,)]
    assert not_in(left, spark.createDataFrame([(1,), (None,)], "k int"), "k").count() == 0
    assert not_in(left, spark.createDataFrame([], "k int"), "k").count() == 3


def test_bands_and_rounding(spark):
    df = spark.createDataFrame([(6.99,), (7.0,), (30.0,)], "v double")
    open_, closed = band("v", [(7, "a"), (30, "b")], "c"), band("v", [(7, "a"), (30, "b")], "c", closed=True)
    assert [tuple(r) for r in df.select(open_, closed).collect()] == [("a", "a"), ("b", "a"), ("c", "b")]
    row = spark.sql("SELECT 31620.498D / 1.04D AS x, 0 AS z").select(rnd("x"), pct("x", "z", 2)).first()
    assert tuple(row) == (30404.33, None)
