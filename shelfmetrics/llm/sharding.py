"""Placement of rows on shards by a lookup table that shards fill in turns; DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: list[str], size: int) -> list[int]:
    """For each slot the place of its shard in `shards`.

    Each shard walks the slots in its own order: from an offset, by a stride, both hashed from its name; as the size is prime the walk meets
    every slot. Shards take turns, and each claims the first free slot of its walk. So shares differ by at most one slot, and when a shard
    comes or goes few other slots change hands. The work depends on `size` alone, never on the data.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime, not below the number of shards")
    walk = [(_number(f"offset {s}") % size, _number(f"stride {s}") % (size - 1) + 1) for s in shards]
    steps, owner = [0] * len(shards), [-1] * size
    for turn in range(size):
        k = turn % len(shards)
        offset, stride = walk[k]
        while owner[slot := (offset + steps[k] * stride) % size] >= 0:
            steps[k] += 1
        owner[slot] = k
    return owner


def slot_of(key: Column, size: int) -> Column:
    """A key's slot: the first eight hexadecimal digits of its MD5, modulo the size. A null key counts as the empty string."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(size))


def table_frame(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """slot, shard: one row per slot, made inside Spark from one literal of `size` short numbers."""
    names = F.array(*[F.lit(s) for s in shards])
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("at", "owner")).select(
        F.col("at").cast("bigint").alias("slot"), F.get(names, F.col("owner").cast("int")).alias("shard"))


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = 65537) -> DataFrame:
    """docs with two columns more, `slot` and `shard` (own columns of these names are replaced).

    The table of `size` rows is broadcast; each row finds its shard in constant time, without a shuffle, so hot values of other columns do not
    matter. Rows with equal keys meet on one shard; null keys go to the shard of the empty string; an empty table gives no rows.
    """
    table = F.broadcast(table_frame(docs.sparkSession, shards, size))
    return docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key}`"), size)).join(table, "slot").select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")
