"""Queries of the operators over the given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language
from .bpe_count import count_tokens
from .chat_format import expand, in_batches, parse, unescape
from .common import read, stored
from .decontamination import contamination
from .exact_dedup import exact_dedup
from .jaccard_join import near_duplicates
from .packing import pack
from .prefix_trie import keys, share_beginnings, trie
from .sharding import place
from .simhash_pivots import simhash_components
from .spelling_grams import spelling_forms
from .substring_dedup import remove_repeats
from .toxicity import classify

SHARDS = [f"shard-{i:02d}" for i in range(24)]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low quality first, then toxicity; the labels' columns are the categories."""
    labels = read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    scored = classify(read(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_low_quality") >= 0.5).alias("low_quality"), (F.col("p_toxic") >= 0.5).alias("toxic"))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~apart))
    return language.predict(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score", "rejected")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("tiles")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


PIECES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("turns", pa.string()), ("loss", pa.string()), ("loss_chars", pa.int64()),
                    ("formatted_chars", pa.int64())])
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                    ("formatted_chars", pa.int64())])


def _added(examples: Iterator[tuple], most: int) -> Iterator[tuple]:
    """What examples add to those before them: their turns and trained text as read back, examples that follow each other joined up to `most` characters."""
    conv, following, whole, piece, size = None, None, "", None, 0

    def close():
        first, n, turns, loss, formatted = piece
        loss = "".join(loss)
        return conv, first, n, "".join(turns), loss, len(loss), formatted

    for key, example, text, start, stop in examples:
        if key == conv and example == following:
            if not text.startswith(whole):
                raise ValueError(f"conversation {key}: example {example} does not begin with the one before it")
            turns = parse(text[len(whole):])
        else:  # the first of a block: its own turns follow the last reply before the target
            if piece:
                yield close()
            turns, piece = parse(text), None
            turns = turns[max((i + 1 for i, (role, _) in enumerate(turns[:-1]) if role == "assistant"), default=0):]
        if piece is None:
            piece, size = [example, 0, [], [], 0], 0
        said = "".join(f"{role}\n{said}\n" for role, said in turns)
        piece[1] += len(turns)
        piece[2].append(said)
        piece[3].append(unescape(text[start:stop]))
        piece[4] += len(text)
        conv, following, whole, size = key, example + 1, text, size + len(said)
        if size >= most:
            yield close()
            piece = None
    if piece:
        yield close()


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def examples():
        for b in batches:
            key, example, text, start, stop = (b.column(c) for c in ("conv_id", "example", "text", "loss_start", "loss_end"))
            for k, n, t, x, y in zip(key.to_pylist(), example.to_pylist(), text, start.to_pylist(), stop.to_pylist()):
                yield k, n, t.as_py(), x, y  # one long text at a time

    yield from in_batches(_added(examples(), 1 << 20), PIECES, text=3)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose pieces follow each other."""
    done: list[list] = [[] for _ in DIGEST]
    state = None

    def close():
        conv, n, turns, chars, loss, formatted = state
        for col, x in zip(done, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)):
            col.append(x)

    for b in batches:
        for conv, example, n, turns, loss, chars, formatted in zip(*[c.to_pylist() for c in b.columns]):
            if state is None or example == 0:
                if state:
                    close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += n
            state[2].update(turns.encode("utf-8", "surrogatepass"))
            state[3] += chars
            state[4].update(loss.encode("utf-8", "surrogatepass"))
            state[5] += formatted
        if len(done[0]) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, DIGEST)], schema=DIGEST)
            done[:] = [[] for _ in DIGEST]
    if state:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, DIGEST)], schema=DIGEST)


def read_back(examples: DataFrame) -> DataFrame:
    """One row of digests per conversation. Examples are read where they were built; only what each adds goes, in order, to the conversation's task."""
    pieces = examples.mapInArrow(_read_back, "conv_id bigint, example bigint, n_turns bigint, turns string, loss string, loss_chars bigint, formatted_chars bigint")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(
        _digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    examples = expand(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    return read_back(examples)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(read(spark, sf_dir, "documents"), SHARDS, size=2503).select("doc_id", "slot", "shard")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op11_spelling_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(read(spark, sf_dir, "documents"))


def op12_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"), width=4, radius=4)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(keys(read(spark, sf_dir, "conversations")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return trie(stored(share_beginnings(own, every=100, begins=h, most=5)))


QUERIES = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_language, op4_decontamination, op5_substring_dedup, op6_chat_format, op7_jaccard_join, op8_sharding, op9_token_counts, op10_exact_dedup,
                                   op11_spelling_grams, op12_simhash_pivots, op13_prefix_trie)}
