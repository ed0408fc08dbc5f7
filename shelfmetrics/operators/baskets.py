"""Products bought together."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pair_counts(lines: DataFrame, basket: str, item: str, label: str, block: int = 1000, sizes: DataFrame | None = None) -> DataFrame:
    """Line pairs (a, b) of one basket with a.item < b.item, counted by label pair: (label_a, label_b, together).

    A basket of at most ``block`` lines is listed beside each of its lines and its pairs are counted where they arise, so lines are shuffled by
    basket once and no pair is. A larger basket is reduced to one row per item, with their number, and cut into blocks whose pairs are join keys of
    their own, so no task ever holds one huge basket. Nothing is dropped. ``sizes`` may be a cheaper frame with at least the lines of every basket."""
    known = lines.filter(F.col(basket).isNotNull())
    # dealt by size, so that what is left is a stage of its own and joined by its real size
    big = ((lines if sizes is None else sizes).groupBy(basket).agg(F.count("*").alias("size")).filter(F.col("size") > block).repartition("size"))
    both = _small_pairs(known.join(big, basket, "left_anti"), basket, item, label).unionByName(
        _block_pairs(known.join(big, basket), basket, item, label, block))
    return both.groupBy("label_a", "label_b").agg(F.sum("together").alias("together"))


def _small_pairs(lines: DataFrame, basket: str, item: str, label: str) -> DataFrame:
    every = F.collect_list(F.struct(F.col(item).alias("item"), F.col(label).alias("label"))).over(Window.partitionBy(basket))
    listed = lines.select(F.col(item).alias("item_a"), F.col(label).alias("label_a"), every.alias("every"))
    later = F.explode(F.filter("every", lambda b: b["item"] > F.col("item_a")))
    return listed.select("label_a", later.alias("b")).groupBy("label_a", F.col("b.label").alias("label_b")).agg(F.count("*").alias("together"))


def _block_pairs(lines: DataFrame, basket: str, item: str, label: str, block: int) -> DataFrame:
    items = lines.groupBy(basket, item, label, "size").agg(F.count("*").alias("times"))
    blocks = items.withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64(item), F.col("parts")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = blocks.select(F.col(basket).alias("_basket"), own.alias("_i"), others.alias("_j"), F.col(item).alias("item_a"),
                         F.col(label).alias("label_a"), F.col("times").alias("times_a"))
    right = blocks.select(F.col(basket).alias("_basket"), others.alias("_i"), own.alias("_j"), F.col(item).alias("item_b"),
                          F.col(label).alias("label_b"), F.col("times").alias("times_b"))
    pairs = left.join(right, ["_basket", "_i", "_j"]).filter(F.col("item_a") < F.col("item_b"))
    return pairs.groupBy("label_a", "label_b").agg(F.sum(F.col("times_a") * F.col("times_b")).alias("together"))
