"""Removal of byte strings that stand more than once, found by suffix arrays over shards."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stored, texts
from .suffix_array import common_prefixes, suffix_array

BASE = 0x9E3779B97F4A7C15
SPREAD = np.uint64(0xD6E8FEB86659FD93)
PIECE = 1 << 20  # window starts of a document hashed at a time
SHARD_BYTES = 1 << 20  # of a suffix array, about
GROUP_BYTES = 1 << 18  # an anchor with more context than this is cut


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of each place, and its inverse, modulo 2 ** 64."""
    def run(x: int) -> np.ndarray:
        return np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(x))], dtype=np.uint64)
    return run(BASE), run(pow(BASE, -1, 1 << 64))


def anchors(data: bytes, least: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash of the anchor, first window start, number of starts, hash of the context) of a document, a piece at a time.

    A window is `least` bytes from some start; its anchor is the `gram` bytes in it of the lowest hash, the leftmost of equal ones. It depends on
    the window alone, so equal windows have equal anchors. Neighbouring starts with one anchor make a context: the bytes of their windows.
    """
    width, starts = least - gram + 1, len(data) - least + 1
    for at in range(0, starts, PIECE):
        a = np.frombuffer(data, np.uint8)[at:at + PIECE + least - 1]
        n = len(a)
        power, inverse = _powers(PIECE + least)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1]
        h = (h ^ (h >> np.uint64(32))) * SPREAD
        h ^= h >> np.uint64(29)
        low = (h >> np.uint64(21) << np.uint64(21)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        place = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, len(place)])
        context = (sums[first + count + least - 1] - sums[first]) * inverse[first]
        context = ((context ^ (context >> np.uint64(32))) + count.astype(np.uint64)) * SPREAD
        yield h[place[first]], first + at, count, context


def _anchor_rows(least: int, gram: int):
    names = ["anchor", "key", "print", "start", "count", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 4 << 20):
            key, print_, parts, row = b.column("key"), b.column("print"), [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for found in anchors(text.encode("utf-8", "replace"), least, gram):
                    parts.append(found)
                    row.append(np.full(len(found[0]), i))
            if parts:
                h, start, count, context = (np.concatenate(c) for c in zip(*parts))
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), key.take(at), print_.take(at), pa.array(start), pa.array(count.astype(np.int32)),
                                                  pa.array(context.view(np.int64))], names=names)
    return run


def _cut(least: int):
    """The bytes of the wanted contexts of each document, once in a task for rows that repeat id and text."""
    names = ["shard", "anchor", "context", "copies", "cut", "count", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for b in by_bytes(batches, 4 << 20):
            rows: list[list] = [[] for _ in names]
            for key, print_, text, wanted in zip(*[b.column(c).to_pylist() for c in ("key", "print", "text", "wanted")]):
                if (key, print_) in done:
                    continue
                done.add((key, print_))
                data = text.encode("utf-8", "replace")
                for w in wanted:
                    for col, x in zip(rows, (w["shard"], w["anchor"], w["context"], w["copies"], w["cut"], w["count"], data[w["start"]:w["start"] + w["count"] + least - 1])):
                        col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
    return run


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]


RUNS = pa.list_(pa.struct([("from", pa.int32()), ("until", pa.int32())]))
LOOSE = pa.list_(pa.struct([("at", pa.int32()), ("window", pa.binary())]))


def _sort_shard(least: int):
    """Which windows of a shard's contexts stand in it twice: those whose suffix shares `least` bytes with a neighbour in the suffix array."""
    def run(table: pa.Table) -> pa.Table:
        first: dict[tuple[int, int], int] = {}
        for i, context in enumerate(zip(table.column("anchor").to_pylist(), table.column("context").to_pylist())):
            first.setdefault(context, i)  # cut by two tasks from rows that repeat id and text
        if len(first) < table.num_rows:
            table = table.take(pa.array(first.values(), pa.int64()))
        data, count = table.column("data").to_pylist(), table.column("count").to_numpy().astype(np.int64)
        copies, cut = table.column("copies").to_numpy(), table.column("cut").to_pylist()
        size = np.array([len(d) for d in data])
        begin = np.cumsum(size + 1) - size - 1
        s = np.frombuffer(b"\0".join(data) + b"\0\0", np.uint8).astype(np.int64) + 2
        s[begin + size] = 1  # ends a context
        s[-1] = 0
        before, shared = common_prefixes(s, suffix_array(s, 258), 1)
        twice = shared >= least
        twice[before[twice]] = True
        runs, loose = [], []
        for k in range(len(data)):
            flags = twice[begin[k]:begin[k] + count[k]] | (copies[k] > 1)
            runs.append([{"from": int(x), "until": int(y)} for x, y in zip(*ranges(flags))])
            # The rest of a cut anchor lies in other shards: its windows meet by their hash.
            loose.append([{"at": i, "window": xxhash.xxh3_128_digest(data[k][i:i + least])} for i in range(count[k])] if cut[k] else None)
        return pa.table({"anchor": table.column("anchor"), "context": table.column("context"), "runs": pa.array(runs, RUNS), "loose": pa.array(loose, LOOSE)})
    return run


def _remove(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in by_bytes(batches, 4 << 20):
            size, spans, kept = [], [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                data = text.encode("utf-8", "replace")
                gone: list[list[int]] = []
                for x, y in sorted((f["start"], f["stop"]) for f in found or ()):
                    if gone and x <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], y)
                    else:
                        gone.append([x, y])
                at, rest = 0, []
                for x, y in gone:
                    rest.append(data[at:x])
                    at = y
                size.append(len(data))
                spans.append([{"start": x, "stop": y} for x, y in gone])
                kept.append(b"".join([*rest, data[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, least: int = 200, gram: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start, stop), kept: each text as UTF-8 bytes without what `least` bytes standing elsewhere too cover.

    1. Each window of `least` bytes is led to its anchor. Anchors met once cannot lead a repeated window; counts are summed before the shuffle.
    2. Contexts of the other anchors are cut from the texts, equal ones once with their number, and dealt to shards by anchor. An anchor with
       one context only needs no sorting: all its windows are repeated. A shard holds about SHARD_BYTES; an anchor with more context than
       GROUP_BYTES is cut over several, and its windows also meet by 128-bit hashes, which are spread over all tasks.
    3. Each shard's suffix array is induced and its permuted common prefixes give the windows that stand twice.
    4. Windows lead back to the documents; overlapping ones are joined and removed.

    Null and empty texts, and those below `least` bytes, stay whole; texts of any length are treated whole; repeated rows remove each other;
    matches never cross documents; a null doc_id is a document as any other. An empty table gives no rows.
    """
    base = texts(docs, id_col, text_col)
    kind = dict(base.dtypes)["doc_id"]
    # Rows that agree in both have equal text and so the same spans.
    base = base.select("doc_id", "text", F.xxhash64("doc_id").alias("key"), F.xxhash64(F.lit(1), "text").alias("print"))
    rows = base.select("key", "print", "text").filter(F.octet_length("text") >= least).mapInArrow(
        _anchor_rows(least, gram), "anchor bigint, key bigint, print bigint, start bigint, count int, context bigint")
    often = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).filter("n > 1")
    places = stored(rows.join(often, "anchor").select("anchor", "key", "print", "start", "count", "context", (F.col("low") == F.col("high")).alias("alone")))
    # Contexts to sort: one place each.
    one = places.filter("not alone").groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(F.struct("key", "print", "start", "count")).alias("at"))
    bulk = F.col("at.count") + least
    sizes = one.groupBy("anchor").agg(F.sum(bulk).alias("bytes"))
    one = stored(one.join(sizes.select("anchor", F.ceil(F.col("bytes") / GROUP_BYTES).alias("parts")), "anchor"))
    shards = int(-(-(one.agg(F.sum(bulk)).first()[0] or 1) // SHARD_BYTES))
    part = F.when(F.col("parts") > 1, F.pmod("context", F.col("parts"))).otherwise(0)
    wanted = one.select("at.key", "at.print", F.struct(F.pmod(F.xxhash64("anchor", part), F.lit(shards)).alias("shard"), "anchor", "context", "copies",
                                                       (F.col("parts") > 1).alias("cut"), "at.start", "at.count").alias("w"))
    wanted = wanted.groupBy("key", "print").agg(F.collect_list("w").alias("wanted"))  # of one document
    pieces = base.select("key", "print", "text").join(wanted, ["key", "print"]).mapInArrow(
        _cut(least), "shard bigint, anchor bigint, context bigint, copies bigint, cut boolean, count int, data binary")
    sorted_ = stored(pieces.groupBy("shard").applyInArrow(
        _sort_shard(least), "anchor bigint, context bigint, runs array<struct<from:int,until:int>>, loose array<struct<at:int,window:binary>>"))
    runs = sorted_.select("anchor", "context", F.explode("runs").alias("r")).select("anchor", "context", "r.from", "r.until")
    loose = sorted_.filter("loose IS NOT NULL").select("anchor", "context", F.explode("loose").alias("w")).select("anchor", "context", "w.at", "w.window")
    met = loose.join(loose.groupBy("window").count().filter("count > 1"), "window").select("anchor", "context", F.col("at").alias("from"), (F.col("at") + 1).alias("until"))
    found = places.filter("not alone").join(runs.union(met), ["anchor", "context"]).select(
        "key", "print", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("until") + (least - 1)).alias("stop"))
    found = found.union(places.filter("alone").select("key", "print", "start", (F.col("start") + F.col("count") + (least - 1)).alias("stop")))
    found = found.groupBy("key", "print").agg(F.collect_set(F.struct("start", "stop")).alias("found"))  # of one document
    return base.join(found, ["key", "print"], "left").select("doc_id", "text", "found").mapInArrow(
        _remove(least), f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
