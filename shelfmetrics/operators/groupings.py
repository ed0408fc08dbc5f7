"""Sums by several groupings of one frame."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import stored_columns


@dataclass(frozen=True)
class Grouping:
    """Sums by ``keys`` of the rows for which ``where`` holds."""
    keys: Sequence[str]
    sums: dict[str, Column]
    where: Column | None = None


def sums_together(df: DataFrame, groupings: Sequence[Grouping]) -> list[DataFrame]:
    """One frame of sums per grouping; df is computed once for all. GROUPING SETS would sum every column for every grouping; here a row is dealt to each
    grouping with the columns that it asks for. Sums of one name share a column, so they must be of one type. The sums are stored, because each frame reads a part.
    A grouping without keys has no row if df has none."""
    keys = list(dict.fromkeys(k for g in groupings for k in g.keys))
    names = list(dict.fromkeys(n for g in groupings for n in g.sums))
    types = {n: df.select(g.sums[n].alias(n)).schema[n].dataType for g in groupings for n in g.sums}

    def dealt(i: int, g: Grouping) -> Column:
        at = F.lit(i) if g.where is None else F.when(g.where, F.lit(i))
        return F.struct(at.alias("_grouping"), *[(F.col(k) if k in g.keys else F.lit(None).cast(df.schema[k].dataType)).alias(f"_k_{k}") for k in keys],
                        *[g.sums.get(n, F.lit(None)).cast(types[n]).alias(n) for n in names])

    rows = df.select(F.inline(F.array(*[dealt(i, g) for i, g in enumerate(groupings)]))).filter(F.col("_grouping").isNotNull())
    stored = stored_columns(rows.groupBy("_grouping", *[f"_k_{k}" for k in keys]).agg(*[F.sum(n).alias(n) for n in names]))
    return [stored.filter(F.col("_grouping") == i).select(*[F.col(f"_k_{k}").alias(k) for k in g.keys], *g.sums) for i, g in enumerate(groupings)]
