"""Prefix-target expansion of conversations: one training example for each assistant turn."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

CONTROL = re.compile(r"[\\#<:]")  # every control string of the template holds one of these
END = " </turn>\n"
EXAMPLE = "conv_id {}, example bigint, target_turn bigint, text string, loss_start bigint, loss_end bigint"


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def head(role: str) -> str:
    return f"### {escape(role)}: "


TURN = re.compile(r"### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<:]++|\\.)*+)</turn>\n", re.DOTALL)  # the second group ends with the blank before the mark


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; raises if anything else stands between."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if m is None or not m[2].endswith(" "):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2][:-1])))
        at = m.end()
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of about `most` characters of the text column."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + (len(r[text]) if text is not None else 0)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


PLACED = "conv_id {}, slice int, row bigint, opened boolean, turn bigint, target boolean, before bigint, done bigint, out bigint, lead bigint, chars bigint, piece string"


def _mapped(rows, fields: list[tuple[str, pa.DataType]], text: int):
    """rows (an iterator of tuples to one of tuples that begin with conv_id) over record batches; the type of conv_id stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *fields])
        yield from in_batches(rows(_rows(itertools.chain([first], batches))), schema, text=text)
    return run


def _number(target_role: str):
    """The formatted turns of a slice with what stands before each in its conversation as far as the slice goes: characters, targets, characters of examples.

    `opened` marks the conversation that opens the slice, of which earlier slices may hold turns.
    """
    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        part, current, opened, before, done, out = TaskContext.get().partitionId(), None, True, 0, 0, 0
        for row, (conv, turn, role, text) in enumerate(found):
            if row and conv != current:
                opened, before, done, out = False, 0, 0, 0
            current, lead, target = conv, head(role), role == target_role
            piece = lead + escape(text) + END
            yield conv, part, row, opened, turn, target, before, done, out, len(lead), len(piece), piece
            before += len(piece)
            if target:
                done, out = done + 1, out + before

    i, b = pa.int64(), pa.bool_()
    return _mapped(rows, [("slice", pa.int32()), ("row", i), ("opened", b), ("turn", i), ("target", b), ("before", i), ("done", i), ("out", i), ("lead", i), ("chars", i),
                          ("piece", pa.string())], 11)


def _carried(placed: DataFrame) -> list[tuple[int, int, int, int]]:
    """(slice, characters, targets, characters of examples) that earlier slices hold of the conversation that opens the slice."""
    stop = F.col("before") + F.col("chars")
    last = F.struct("conv_id", "opened", stop.alias("chars"), (F.col("done") + F.col("target").cast("int")).alias("done"),
                    (F.col("out") + F.when(F.col("target"), stop).otherwise(0)).alias("out"))
    ends = placed.groupBy("slice").agg(F.min_by("conv_id", "row").alias("first"), F.max_by(last, "row").alias("last")).sort("slice").collect()  # one row per slice
    found, conv, total = [], None, None
    for e in ends:
        chars, done, out = total if total and e.first == conv else (0, 0, 0)
        if chars:
            found.append((e.slice, chars, done, out))
        own, conv = e.last, e.last.conv_id
        total = (chars + own.chars, done + own.done, out + own.out + own.done * chars) if own.opened else (own.chars, own.done, own.out)
    return found


def _examples(found: Iterator[tuple]) -> Iterator[tuple]:
    group, k, transcript, pending = None, 0, "", False
    for conv, block, at, whole, turn, target, lead, done, piece in found:
        if group != (conv, block):
            if pending:
                yield group[0], k, None, transcript, len(transcript), len(transcript)
            group, transcript, pending = (conv, block), "", False
        if at != len(transcript):
            raise ValueError(f"conversation {conv}: {len(transcript)} characters before place {at}")
        transcript += piece
        if not whole:
            pending, k = not target, done
            if target:
                yield conv, k, turn, transcript, at + lead, len(transcript) - len(END)
    if pending:
        yield group[0], k, None, transcript, len(transcript), len(transcript)


def expand(conversations: DataFrame, target_role: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", block_chars: int = 1 << 28) -> DataFrame:
    """conv_id, example, target_turn, text, loss_start, loss_end: one row per turn of the target role, and one for turns after the last of them.

    `text` is the transcript up to and with the target turn, each turn as `### role: text </turn>`; texts and roles are escaped so that `parse`
    gives them back. Only characters loss_start to loss_end of it, the target's escaped text, are to be trained on; a row without a target
    (target_turn null) has an empty span and lets turns that follow the last reply be read back.

    1. Turns are placed by ranges of conversation and order, so that a long conversation lies in many slices, formatted there and stored.
    2. Each slice counts its turns by itself; what earlier slices hold of a conversation is added (one row per slice on the driver).
    3. Examples are dealt by conversation and block: a block holds consecutive examples of about `block_chars` characters in all. What lies before
       a block reaches it joined to one piece for each slice and earlier block. A worker holds one transcript, never a list of turns.

    Null roles and texts are empty; a null conv_id is a conversation of its own; turns of equal number, repeated rows included, go by role and
    text, a null number first. An empty table gives no rows. A transcript over 2 GB, which no Spark string can hold, fails and is not cut.
    """
    spark = conversations.sparkSession
    ship(spark)
    kind = dict(conversations.dtypes)[id_col]
    turns = conversations.select(
        F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # The bounds of the ranges are drawn on the driver: the beginnings of texts are enough for them.
    dealt = turns.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 256))
    placed = stored(dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_number(target_role), PLACED.format(kind)))
    base = spark.createDataFrame(_carried(placed), "slice int, b_chars bigint, b_done bigint, b_out bigint")
    more = {c: F.when(F.col("opened"), F.coalesce(c, F.lit(0))).otherwise(0) for c in ("b_chars", "b_done", "b_out")}
    placed = placed.join(F.broadcast(base), "slice", "left").withColumns(more).select(
        "conv_id", F.floor((F.col("out") + F.col("b_out") + F.col("done") * F.col("b_chars")) / block_chars).alias("block"),
        (F.col("before") + F.col("b_chars")).alias("at"), "turn", "target", "lead", (F.col("done") + F.col("b_done")).alias("done"), "piece", "slice")
    own = placed.select("conv_id", "block", "at", F.lit(False).alias("whole"), "turn", "target", "lead", "done", "piece")
    several = placed.groupBy("conv_id").agg(F.max("block").alias("last")).filter("last > 0").withColumnRenamed("conv_id", "conv")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    before = placed.join(several, F.col("conv_id").eqNullSafe(F.col("conv"))).filter("block < last").groupBy("conv_id", "block", "slice").agg(
        F.max("last").alias("last"), F.min("at").alias("at"), joined.alias("piece"))
    before = before.select(
        "conv_id", F.explode(F.sequence(F.col("block") + 1, F.col("last"))).alias("block"), "at", F.lit(True).alias("whole"), F.lit(None).cast("bigint").alias("turn"),
        F.lit(None).cast("boolean").alias("target"), F.lit(None).cast("bigint").alias("lead"), F.lit(None).cast("bigint").alias("done"), "piece")
    i = pa.int64()
    run = _mapped(_examples, [("example", i), ("target_turn", i), ("text", pa.string()), ("loss_start", i), ("loss_end", i)], 3)
    return own.unionAll(before).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at").mapInArrow(run, EXAMPLE.format(kind))
