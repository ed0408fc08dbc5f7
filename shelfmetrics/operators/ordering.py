"""Ordered computations over a whole table without gathering it in one task.

A window with ORDER BY and no (or a hot) PARTITION BY sorts everything in one task. Here the rows are range-partitioned
on the order, each slice is numbered on its own, and the totals of the earlier slices (a frame with one row per slice
and group) are added. Numbers, ties, buckets, running shares and exact percentiles follow from that one operator.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut_lineage


def place(df: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """df in slices of ``order`` within ``by``, numbered in ``_slice``. The placement is checkpointed, because every reader must see the same slices even
    after a task is retried. AQE merges neighbouring slices that are small, which keeps their order."""
    return cut_lineage(df.repartitionByRange(*[F.col(b).asc_nulls_first() for b in by], *order).withColumn("_slice", F.spark_partition_id()))


def running_totals(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Add ``row_no``/``row_count`` and, for each name in ``sums``, ``run_<name>``/``all_<name>``: the inclusive running
    total and the grand total in ``order`` within ``by``. The order must be total (end with a key); a hot value is then
    split over slices like any other. A frame that ``place`` has cut in this order is used as it is, so that one placement
    can serve further computations."""
    by, sums = list(by), list(sums)
    placed = df if "_slice" in df.columns else place(df, order, by)

    per_slice = placed.groupBy("_slice", *by).agg(
        F.count("*").alias("_n"), *[F.sum(s).alias(f"_s_{s}") for s in sums])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        F.col("_slice").alias("_at"), *[F.col(b).alias(f"_by_{b}") for b in by],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("row_count"),
        *[F.sum(f"_s_{s}").over(earlier).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(group).alias(f"all_{s}") for s in sums])

    same_slice = F.col("_slice") == F.col("_at")
    for b in by:
        same_slice = same_slice & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    inside = Window.partitionBy("_slice", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumns({
        "_local": F.count("*").over(inside), **{f"_local_{s}": F.sum(s).over(inside) for s in sums}})
    joined = numbered.join(offsets, same_slice)

    def total(s: str) -> Column:
        before = F.col(f"_before_{s}")
        return F.when(before.isNull(), F.col(f"_local_{s}")).otherwise(F.coalesce(F.col(f"_local_{s}") + before, before))

    return joined.select(
        *[c for c in df.columns if c != "_slice"], (F.col("_before") + F.col("_local")).alias("row_no"), "row_count",
        *[c for s in sums for c in (total(s).alias(f"run_{s}"), F.col(f"all_{s}"))])


def quantile_buckets(df: DataFrame, n: int, order: Sequence[Column], out: str, by: Sequence[str] = ()) -> DataFrame:
    """NTILE(n): the first ``count % n`` buckets hold one row more than the rest."""
    numbered = running_totals(df, order, by=by)
    r, size, extra = F.col("row_no"), F.floor(F.col("row_count") / n), F.col("row_count") % n
    wide = extra * (size + 1)
    bucket = (F.when(r <= wide, F.floor((r - 1) / (size + 1)) + 1)
              .otherwise(extra + F.floor((r - wide - 1) / F.nullif(size, F.lit(0))) + 1))
    return numbered.select(*df.columns, bucket.cast("int").alias(out))


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """RANK of every distinct value: one row per (by, value) with ``value_rank``, ``value_rows`` and ``row_count``.
    Ties are counted before the rows are ordered, so a value that fills the table is still one row here."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("value_rows"))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    ordered = running_totals(counts, [order], ["value_rows"], by)
    return ordered.select(*by, value, "value_rows", (F.col("run_value_rows") - F.col("value_rows") + 1).alias("value_rank"),
                          F.col("all_value_rows").alias("total_rows"))


def attach_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """RANK() OVER (PARTITION BY by ORDER BY value) as a column."""
    ranks = value_ranks(df, value, by, descending).select(*by, value, F.col("value_rank").alias(out))
    return _join_back(df, ranks, [*by, value])


def percent_ranks(df: DataFrame, value: str, out: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """PERCENT_RANK(): (rank - 1) / (rows - 1), zero for a single row."""
    r = value_ranks(df, value, by, descending)
    share = F.coalesce((F.col("value_rank") - 1) / F.nullif((F.col("total_rows") - 1).cast("double"), F.lit(0.0)), F.lit(0.0))
    return _join_back(df, r.select(*by, value, share.alias(out)), [*by, value])


def _join_back(df: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    right = ranks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in ranks.columns if c not in keys])
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        match = same if match is None else match & same
    return df.join(right, match).drop(*[f"_k_{k}" for k in keys])


def percentiles(df: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Exact interpolated percentiles (PERCENTILE_CONT): one row per group, one double column per point. Values are
    counted first, so the work follows the number of distinct values and no group's values meet in one buffer."""
    known = df.filter(F.col(value).isNotNull())
    size = F.sum(weight) if weight else F.count("*")
    counts = known.groupBy(*by, F.col(value).cast("double").alias("v")).agg(size.alias("rows"))
    ordered = running_totals(counts, [F.col("v").asc()], ["rows"], by)
    upto, start, last = F.col("run_rows"), F.col("run_rows") - F.col("rows"), F.col("all_rows") - 1

    def value_at(index: Column) -> Column:
        return F.max(F.when((start <= index) & (index < upto), F.col("v")))

    picked = ordered.groupBy(*by).agg(F.max(last).alias("_last"), *[
        c for name, p in points.items() for c in (value_at(F.floor(last * p)).alias(f"_lo_{name}"),
                                                  value_at(F.ceil(last * p)).alias(f"_hi_{name}"))])

    def interpolated(name: str, p: float) -> Column:
        low, high, at = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col("_last") * p
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return picked.select(*by, *[interpolated(n, p) for n, p in points.items()])


def abc_classes(df: DataFrame, value: str, key: str, a: float = 80.0, b: float = 95.0) -> DataFrame:
    """Pareto classes by the cumulative share that precedes each row: ``share_pct``, ``cumulative_pct``, ``abc_class``."""
    run = running_totals(df, [F.col(value).desc_nulls_last(), F.col(key).asc()], [value])
    whole = F.nullif(F.col(f"all_{value}").cast("double"), F.lit(0.0))
    shares = run.select(*df.columns, "row_no", "row_count", F.col(f"all_{value}").alias("total_value"),
                        (F.lit(100.0) * F.col(value).cast("double") / whole).alias("share_pct"),
                        (F.lit(100.0) * F.col(f"run_{value}").cast("double") / whole).alias("cumulative_pct"))
    before = F.col("cumulative_pct") - F.col("share_pct")
    return shares.withColumn("abc_class", F.when(before < a, "A").when(before < b, "B").otherwise("C"))
