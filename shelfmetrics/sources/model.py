"""The retail model: nineteen named tables, each a lazily opened DataFrame."""
from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import BUCKETED, open_buckets
from .schemas import TABLES, schema_of


KEYED = "+key"


def shared(plan: Callable[["Retail"], DataFrame]) -> Callable[["Retail"], DataFrame]:
    """Build a plan once per model. It is the lazy plan that is kept, never its rows."""
    @functools.wraps(plan)
    def build(m: "Retail") -> DataFrame:
        if plan.__name__ not in m._plans:
            m._plans[plan.__name__] = plan(m)
        return m._plans[plan.__name__]
    return build


class Retail:
    """Tables by attribute (``m.sales_orders``). A table is opened on first use and never collected here."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        unknown = {t.removesuffix(KEYED) for t in tables} - set(TABLES)
        if unknown:
            raise KeyError(f"not retail tables: {sorted(unknown)}")
        self.spark = spark
        self._tables = dict(tables)
        self._plans: dict[str, DataFrame] = {}
        self.given: dict[str, DataFrame] = {}

    def keyed(self, name: str) -> DataFrame:
        """The table with its own key. A source that has to work for the key (a place in a file) offers the table twice;
        plans ask for the key only where they join on it or return it."""
        return self._open(name + KEYED if name + KEYED in self._tables else name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._tables:
            raise AttributeError(f"table {name} is not part of this model")
        return self._open(name)

    def _open(self, name: str) -> DataFrame:
        frame = self._tables[name]
        if not isinstance(frame, DataFrame):
            frame = self._tables[name] = frame()
        return frame

    def names(self) -> list[str]:
        return [t for t in TABLES if t in self._tables]

    def with_tables(self, **frames: DataFrame | Callable[[], DataFrame]) -> "Retail":
        kept = {t: f for t, f in self._tables.items() if t.removesuffix(KEYED) not in frames}
        return Retail(self.spark, {**kept, **frames})

    def with_plans(self, **frames: DataFrame) -> "Retail":
        """The same tables with stored results in place of shared plans, by the plan's name; those given before are kept."""
        m = Retail(self.spark, self._tables)
        m.given = {**self.given, **frames}
        m._plans.update(m.given)
        return m

    def register_views(self) -> None:
        """Expose every table as a temp view, for ad-hoc SQL."""
        for name in self.names():
            getattr(self, name).createOrReplaceTempView(name)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, buckets: int | None = None) -> "Retail":
        """Tables in folders of their names; ``buckets`` is the number that orders and lines were written with, if they were."""
        def opened(t: str) -> DataFrame:
            return open_buckets(spark, f"{root}/{t}", t, buckets) if buckets and t in BUCKETED else spark.read.parquet(f"{root}/{t}")

        return cls(spark, {t: functools.partial(opened, t) for t in TABLES})

    @classmethod
    def from_csv(cls, spark: SparkSession, root: str) -> "Retail":
        return cls(spark, {t: (lambda t=t: read_csv(spark, f"{root}/{t}.csv", t)) for t in TABLES})


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """CSV with a header; an empty field is NULL; no schema inference."""
    return (spark.read.schema(schema_of(table)).option("header", True).option("nullValue", "")
            .option("mode", "FAILFAST").csv(path))


def read_records(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The same, but a record that does not parse (a value of another type, too few or too many fields) comes with its text in ``record`` instead of
    ending the job; ``file`` is where a record was found."""
    fields = schema_of(table).add("record", "string")
    rows = (spark.read.schema(fields).option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "record").csv(path))
    return rows.select("*", F.col("_metadata.file_path").alias("file"))
