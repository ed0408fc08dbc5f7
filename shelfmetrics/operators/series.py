"""Series over bounded time grains (months, weeks, one row per key and day)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _over(order: str, by: Sequence[str] = ()):
    return Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())


def previous(column: str, order: str, steps: int = 1, by: Sequence[str] = ()) -> Column:
    return F.lag(column, steps).over(_over(order, by))


def running(column: str, order: str, by: Sequence[str] = ()) -> Column:
    return F.sum(column).over(_over(order, by))


def trailing_mean(column: str, order: str, rows: int, only_full: bool = True) -> Column:
    w = _over(order)
    mean = F.avg(column).over(w.rowsBetween(1 - rows, 0))
    return F.when(F.row_number().over(w) >= rows, mean) if only_full else mean


def gap_days(df: DataFrame, key: str, day: str) -> DataFrame:
    """Days since the key's previous event, for every event but the first: (key, day, gap_days, events).

    Events are first reduced to key and day. Further events of the same day have gap 0 and are returned as one row
    with their number, so a key with very many events still holds one row per calendar day."""
    days = df.groupBy(key, day).agg(F.count("*").alias("n"))
    w = _over(day, [key])
    spaced = days.withColumn("gap", F.datediff(F.col(day), F.lag(day).over(w)))
    between = spaced.filter(F.col("gap").isNotNull()).select(key, day, F.col("gap").alias("gap_days"), F.lit(1).cast("bigint").alias("events"))
    same_day = spaced.filter(F.col("n") > 1).select(key, day, F.lit(0).alias("gap_days"), (F.col("n") - 1).alias("events"))
    return between.unionByName(same_day)


def consecutive_runs(df: DataFrame, key: str, step: str) -> DataFrame:
    """Gaps and islands over distinct integer steps: (key, first, last, length) of every unbroken run."""
    w = _over(step, [key])
    marked = df.select(key, step).distinct().withColumn("_run", F.col(step) - F.row_number().over(w))
    return marked.groupBy(key, "_run").agg(
        F.min(step).alias("first"), F.max(step).alias("last"), F.count("*").alias("length")).drop("_run")
