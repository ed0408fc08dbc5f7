"""Small frame-level helpers."""
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .columns import pct


def one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side join of one-row aggregates: stack them, then keep the only value of each column."""
    stack = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stack.agg(*[F.max(c).alias(c) for c in stack.columns])


def stacked(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def part_of_total(df: DataFrame, column: str, out: str, digits: int | None = 2, bounded: bool = True) -> DataFrame:
    """Percent share of a column. A bounded frame (months, stores, bands) uses an empty window, which is one task
    over a few rows; an unbounded one divides by a scalar aggregate instead."""
    total = F.sum(column).over(Window.partitionBy()) if bounded else df.agg(F.sum(column)).scalar()
    return df.withColumn(out, pct(column, total, digits))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def inline_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few literal rows as a local relation: its size is known, so a join with it is broadcast."""
    def literal(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    fields = StructType.fromDDL(ddl).fields
    names = ", ".join(f.name for f in fields)
    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return table.select(*[F.col(f.name).cast(f.dataType) for f in fields])
