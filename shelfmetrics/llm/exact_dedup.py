"""Exact duplicates by two passes over a Bloom filter of text hashes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64  # slots in one row of the filter
PER_ROW = 8  # slots for each row of docs, at least: with two hashes some 95 of 100 rows without copies have a slot of their own


def _slot(text: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), text), F.lit(bits))


def _word(slot: Column) -> Column:
    return F.floor(slot / WORD)


def repeated_filter(docs: DataFrame, bits: int, hashes: int) -> DataFrame:
    """word, bits: the slots that two or more rows of docs hit by their `text`, 64 to a row, so bits / 64 rows at most whatever the input.

    Hits are summed before the shuffle.
    """
    slots = docs.select(F.explode(F.array(*[_slot(F.col("text"), seed, bits) for seed in range(hashes)])).alias("slot"))
    often = slots.groupBy("slot").count().filter("count > 1")
    return often.groupBy(_word(F.col("slot")).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(slot, {WORD}) AS INT))")).alias("bits"))


def filter_slots(rows: int) -> int:
    """The slots of the filter for so many rows, a power of two: it fills alike at every size."""
    return 1 << max(10, (PER_ROW * rows - 1).bit_length())


def _marked(rows: DataFrame, n: int, bits: int | None, hashes: int, most_words: int) -> DataFrame:
    """The n rows, which have a `text` without nulls, with text_sha256 in its place, and `maybe`: false if surely no other row has the text."""
    bits = bits or filter_slots(n)
    words = repeated_filter(rows, bits, hashes)
    if bits // WORD <= most_words:
        words = F.broadcast(words)  # bits / 64 rows of 16 bytes at most
    marked = rows.withColumn("maybe", F.lit(True)).withColumn("text_sha256", F.sha2("text", 256))
    marked = marked.withColumns({f"slot{seed}": _slot(F.col("text"), seed, bits) for seed in range(hashes)}).drop("text")
    for seed in range(hashes):
        hit = F.getbit(F.coalesce("bits", F.lit(0).cast("bigint")), F.pmod(f"slot{seed}", F.lit(WORD)).cast("int")) == 1
        marked = marked.withColumn("word", _word(F.col(f"slot{seed}"))).join(words, "word", "left").withColumn("maybe", F.col("maybe") & hit).drop("word", "bits")
    return marked.drop(*[f"slot{seed}" for seed in range(hashes)])


def _groups(several: DataFrame) -> DataFrame:
    return several.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, hashes: int = 2, salts: int = 16, most_words: int = 1 << 24) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document.

    The first pass counts, in a Bloom filter, which slots several rows hit. The second pass tests each row: if one of its slots was hit once, no other
    row has its text, and it goes straight through. Only the rest is grouped by SHA-256, summed before the shuffle, and meets its group's row. The
    filter has `bits` slots, by default PER_ROW for each row (counted), so it fills alike at every size; up to `most_words` words of it are
    broadcast (16 bytes each, 256 MB at most), a larger one is joined by shuffle. Groups of over a thousandth of all rows, a thousand at
    most, are spread over `salts` partitions by their rows' places, so that a text with very many copies does not end in one task.

    Of equal texts the row with the largest doc_id stays; null text is the empty text; a null doc_id stays only among nulls. Rows that repeat
    doc_id and text alike count in group_size and share the value of kept. Texts of any length are hashed whole. An empty table gives no rows. Other
    columns play no part.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = rows.count()
    marked = _marked(rows, n, bits, hashes, most_words)
    alone = marked.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                              F.lit(True).alias("kept"), "text_sha256")
    several = marked.filter("maybe")
    groups = _groups(several)
    large = F.col("group_size") * 1000 > n
    hot = F.broadcast(groups.filter(large).select("text_sha256", F.lit(True).alias("hot")))  # a thousand rows at most
    place = F.pmod(F.xxhash64("doc_id") + F.spark_partition_id(), F.lit(salts))
    dealt = several.join(hot, "text_sha256", "left").withColumn("salt", F.when(F.col("hot"), place).otherwise(0)).drop("hot")
    groups = groups.withColumn("salt", F.explode(F.when(large, F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))))
    grouped = dealt.join(groups, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionAll(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, hashes: int = 2, most_words: int = 1 << 24) -> DataFrame:
    """The rows of docs, all columns as they are, that `exact_dedup` keeps; of rows alike in id and text one stays.

    Null, empty and long texts, null ids, an empty table and other columns are treated as there.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    marked = _marked(rows, rows.count(), bits, hashes, most_words)
    several = marked.filter("maybe")
    groups = _groups(several.select("doc_id", "text_sha256"))
    match = (several.text_sha256 == groups.text_sha256) & several.doc_id.eqNullSafe(groups.keep_id)
    last = several.join(groups, match, "left_semi").groupBy("text_sha256").agg(F.first("row").alias("row"))
    return marked.filter("not maybe").select("row.*").unionAll(last.select("row.*"))
