"""The calendar dimension: one row per day."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_calendar(spark: SparkSession, first: str = "2021-01-01", last: str = "2026-12-31") -> DataFrame:
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date_key"))
    d = F.col("date_key")
    iso_day = F.weekday(d) + 1
    return days.select(
        d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "yyyy-MM").alias("year_month"),
        F.weekofyear(d).alias("week_of_year"), F.dayofmonth(d).alias("day_of_month"), iso_day.alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"), (iso_day >= 6).alias("is_weekend"))


def append_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent: the incoming rows whose key is not there yet."""
    return incoming.join(existing.select(*keys), keys, "left_anti")
