"""Parent-child hierarchies held in a dimension table."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage


def descend(df: DataFrame, key: str, parent: str, label: str) -> DataFrame:
    """Every node below a root: (key, root, depth, path). Each round joins the line above a node to its own, which doubles its length, so rounds
    follow the logarithm of the depth; each is checkpointed. A line that holds a node twice is a cycle and raises."""
    lines = df.select(F.col(key).alias("node"), F.col(parent).alias("up"), F.array(key).alias("line"), F.array(F.col(label).cast("string")).alias("names"))
    while not (growing := lines.filter("up IS NOT NULL")).isEmpty():
        if not growing.filter("size(array_distinct(line)) < size(line)").isEmpty():
            raise ValueError("hierarchy is cyclic")
        above = lines.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("line").alias("line_above"), F.col("names").alias("names_above"))
        longer = growing.join(above, "up").select("node", F.col("next").alias("up"), F.concat("line_above", "line").alias("line"), F.concat("names_above", "names").alias("names"))
        lines = cut_lineage(lines.filter("up IS NULL").unionByName(longer))
    return lines.select(F.col("node").alias(key), F.col("line")[0].alias("root"), F.size("line").alias("depth"), F.array_join("names", " > ").alias("path"))
