"""Whole-number keys of a table as bits: a larger table is filtered by flags of its keys without meeting the table."""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import stored_columns

BLOCK, WORD = 12, 6  # a row holds the bits of 2^12 neighbouring keys in words of 2^6 bits
BITS_MB = 32  # most that goes to all tasks; a fixed value
KNOWN = "known"  # the flag of every key of the table


@dataclass(frozen=True)
class KeyBits:
    """One row per block of keys: its number, and for each flag an array of words."""
    rows: DataFrame
    flags: tuple[str, ...]


def whole(df: DataFrame, key: str) -> bool:
    return df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")


def _long(key: str) -> Column:
    return F.col(key).cast("bigint")


def _word(key: str) -> Column:
    return F.shiftright(_long(key), WORD).bitwiseAND(F.lit((1 << BLOCK - WORD) - 1).cast("bigint")).cast("int")


def _bit(key: str) -> Column:
    return _long(key).bitwiseAND(F.lit((1 << WORD) - 1).cast("bigint")).cast("int")


def key_bits(df: DataFrame, key: str, flags: dict[str, Column], limit_mb: float = BITS_MB) -> KeyBits | None:
    """The bits of df's keys, ``known`` and the flags; None where they are no whole numbers, are not unique, or lie so far apart that their bits
    exceed ``limit_mb``. The bits are stored as Parquet."""
    if not whole(df, key):
        return None
    names = (KNOWN, *flags)
    low, high = df.agg(F.min(_long(key)), F.max(_long(key))).first()
    if low is None or ((high >> BLOCK) - (low >> BLOCK) + 1) * len(names) << BLOCK - 3 > limit_mb * 2 ** 20:
        return None
    at = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(key))
    marked = df.filter(F.col(key).isNotNull()).select(
        F.shiftright(_long(key), BLOCK).alias("_block"), _word(key).alias("_word"),
        *[F.when(F.lit(True) if n == KNOWN else flags[n], at).otherwise(F.lit(0).cast("bigint")).alias(n) for n in names])
    words = marked.groupBy("_block", "_word").agg(F.count("*").alias("_n"), *[F.bit_or(n).alias(n) for n in names])
    blocks = words.groupBy("_block").agg(
        F.sum("_n").alias("_n"), F.sum(F.bit_count(KNOWN)).alias("_keys"), F.map_from_entries(F.collect_list(F.struct("_word", F.struct(*names)))).alias("_at"))

    def filled(n: str) -> Column:
        every = F.sequence(F.lit(0), F.lit((1 << BLOCK - WORD) - 1))
        return F.transform(every, lambda w: F.coalesce(F.try_element_at("_at", w)[n], F.lit(0).cast("bigint"))).alias(n)

    rows = stored_columns(blocks.select("_block", "_n", "_keys", *[filled(n) for n in names]))
    n, keys = rows.agg(F.sum("_n"), F.sum("_keys")).first()
    return KeyBits(rows.drop("_n", "_keys"), names) if n == keys else None


def flagged(df: DataFrame, key: str, bits: KeyBits, only: str, *more: str) -> DataFrame:
    """Rows of df whose key has the flag ``only``, as an inner join with the keys' table would give them; further flags become columns."""
    met = _met(df, key, bits, (only, *more), "inner")
    return met.filter(_has(key, only)).select(*df.columns, *[_has(key, n).alias(n) for n in more])


def marked(df: DataFrame, key: str, bits: KeyBits, flags: dict[str, str]) -> DataFrame:
    """All rows of df with the flags of their keys as columns of the names given; false for keys that the table lacks."""
    met = _met(df, key, bits, flags.values(), "left")
    return met.select(*df.columns, *[F.coalesce(_has(key, n), F.lit(False)).alias(out) for out, n in flags.items()])


def _met(df: DataFrame, key: str, bits: KeyBits, flags: Iterable[str], how: str) -> DataFrame:
    rows = bits.rows.select("_block", *[F.col(n).alias(f"_bits_{n}") for n in dict.fromkeys(flags)])
    return df.join(F.broadcast(rows), F.shiftright(_long(key), BLOCK) == F.col("_block"), how)


def _has(key: str, flag: str) -> Column:
    return F.getbit(F.get(F.col(f"_bits_{flag}"), _word(key)), _bit(key)) == 1
