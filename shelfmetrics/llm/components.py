"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable from each node of edges(a, b), both of one integer type.

    Each round every node takes the smallest label among its neighbours' and then its label's label, so labels cross paths in about the logarithm
    of their length. Labels and edges stay distributed; a round's result is stored in the shared folder; minima are combined before the shuffle, so a node with
    very many edges does not load one task. Nodes without edges are not listed; an empty table gives no rows.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        once = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = once.select(F.col("node").alias("label"), F.col("label").alias("top"))
        twice = stored(once.join(up, "label").select("node", "was", F.least("label", "top").alias("label")))
        labels = twice.select("node", "label")
        if twice.filter("was <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
