"""Near duplicates by SimHash fingerprints, compared through tables of distances to pivots."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stored, texts
from .components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
STEP = 1 << 15  # shingles whose bits are summed at once
# The pivots are the 64 Walsh functions: bit j of pivot i is the parity of i & j. For fingerprints with d differing bits the squares of the 64
# coordinate differences have the mean d, so the largest difference is at least sqrt(d): whatever differs in over radius ** 2 bits is discarded for sure.
PIVOTS = np.array([sum((bin(i & j).count("1") & 1) << j for j in range(64)) for i in range(64)], np.uint64)
FIRST = 8  # pivots looked at before the others
NODES = 1 << 19  # linked fingerprints that a task remembers
SMALL = 64  # fingerprints of a cell up to which all its pairs are looked at side by side with other cells'


def fingerprint(text: str, width: int) -> bytes:
    """The 8 bytes, highest bit first, whose bits are set in over half the XXH64 hashes of the text's shingles; zeros without words."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.r_[0, stops[:n - 1] + 1].tolist()
    stops = stops[min(width, len(words)) - 1:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at:at + STEP], stops[at:at + STEP])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 4 << 20):
            found = np.frombuffer(b"".join([fingerprint(t.as_py(), width) for t in b.column("text")]), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(found)], names=["row", "fp"])
    return run


def parts(radius: int, equal: int) -> list[int]:
    """Masks such that fingerprints within the radius agree in all bits of one: radius + equal blocks, of which `equal` cannot hold a difference."""
    edges = [64 * i // (radius + equal) for i in range(radius + equal + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(blocks, equal)]


def equal_blocks(n: int, radius: int) -> int:
    """The blocks that a cell fixes: so many that n evenly spread fingerprints give two a cell at most."""
    equal = 1
    while n > 2 << (64 * equal // (radius + equal)) and equal < 16:
        equal += 1
    return equal


def _cells(masks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            keys = []
            for k, mask in enumerate(masks):
                h = ((fp & np.uint64(mask)) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
                keys.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp.view(np.int64), len(masks)))], names=["cell", "fp"])
    return run


class Table:
    """Fingerprints with their distances to the pivots."""

    def __init__(self, fp: np.ndarray, radius: int):
        self.fp, self.radius = fp, radius
        self.at = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs (a[i], b[i]) are within the radius: those that no pivot discards are verified."""
        left = np.arange(len(a))
        for own in (slice(0, FIRST), slice(FIRST, None)):
            left = left[np.abs(self.at[a[left], own] - self.at[b[left], own]).max(axis=1, initial=0) <= self.radius]
        return left[np.bitwise_count(self.fp[a[left]] ^ self.fp[b[left]]) <= self.radius]

    def spanning(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links that join what links among own can join, at most len(own) - 1: each found fingerprint is compared with those not found yet."""
        rest = own
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = np.full(len(rest), queue.pop(0))
                near = self.linked(x, rest)
                if len(near):
                    yield x[:len(near)], rest[near]
                    queue.extend(rest[near].tolist())
                    rest = np.delete(rest, near)


class Forest:
    """Components so far; links become stars around a component's smallest fingerprint, so that later rounds over them are few."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def stars(self) -> list[pa.Array]:
        nodes = list(self.up)
        out = [pa.array(nodes, pa.int64()), pa.array([self.root(x) for x in nodes], pa.int64())]
        self.up.clear()
        return out


def within(cell: np.ndarray, fp: np.ndarray, radius: int, forest: Forest) -> None:
    """Adds the links of whole cells, whose rows follow each other."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, len(cell)])
    several = np.repeat(size > 1, size)
    cell, fp = cell[several], fp[several]
    if not len(cell):
        return
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, len(cell)])
    table = Table(fp.view(np.uint64), radius)
    left = np.repeat(first + np.where(size <= SMALL, size, 0), size) - np.arange(len(cell))  # of the own cell, this row included
    step, at = 1, np.flatnonzero(left > 1)
    while len(at):
        near = at[table.linked(at, at + step)]
        forest.add(fp[near], fp[near + step])
        step += 1
        at = at[left[at] > step]
    for start, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        for a, b in table.spanning(np.arange(start, start + n)):
            forest.add(fp[a], fp[b])


LINKS = "a bigint, b bigint, cell bigint, place bigint"


def _compare(radius: int, limit: int):
    """Links inside cells (a, b), from rows by cell; rows of a cell of over `limit` fingerprints pass through (a, cell, place in the cell)."""
    def through(cell: np.ndarray, fp: np.ndarray, place: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(cell), pa.array(np.arange(place, place + len(fp)))], names=["a", "b", "cell", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, none = Forest(), np.zeros(0, np.int64)
        cell, fp, large, passed = none, none, None, 0

        def stars() -> pa.RecordBatch:
            a, b = forest.stars()
            return pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "cell", "place"])

        for b in batches:
            c, f = b.column("cell").to_numpy(), b.column("fp").to_numpy()
            if large is not None:
                n = int(np.searchsorted(c, large, "right"))
                yield through(c[:n], f[:n], passed)
                c, f, passed = c[n:], f[n:], passed + n
            if not len(c):
                continue
            large, cell, fp = None, np.r_[cell, c], np.r_[fp, f]
            n = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            within(cell[:n], fp[:n], radius, forest)
            if len(forest.up) > NODES:
                yield stars()
            cell, fp = cell[n:], fp[n:]
            if len(cell) > limit:
                yield through(cell, fp, 0)
                large, passed, cell, fp = cell[0], len(cell), none, none
        within(cell, fp, radius, forest)
        yield stars()
    return run


def _block(radius: int):
    def run(table: pa.Table) -> pa.Table:
        fp, forest = table.column("fp").to_numpy(), Forest()
        for a, b in Table(fp.view(np.uint64), radius).spanning(np.arange(len(fp))):
            forest.add(fp[a], fp[b])
        return pa.table(forest.stars(), names=["a", "b"])
    return run


def links(fps: DataFrame, radius: int, limit: int = 4096) -> DataFrame:
    """a, b: enough links between the distinct fingerprints `fp`, a stored table, to give all components of the graph of pairs within the radius.

    Fingerprints within the radius agree in all bits of some blocks, so each goes to one cell for each choice of blocks, and more blocks are fixed the more
    fingerprints there are. Inside a cell pairs are discarded by their distances to the pivots, and verified. A task joins what it finds, and gives one
    link per linked fingerprint. A cell of over `limit` fingerprints is cut into blocks, and pairs of blocks are compared in tasks of their own.
    """
    masks = parts(radius, equal_blocks(fps.count(), radius))
    cells = fps.mapInArrow(_cells(masks), "cell bigint, fp bigint").repartition("cell").sortWithinPartitions("cell", "fp")
    found = stored(cells.mapInArrow(_compare(radius, limit), LINKS))
    large = found.filter("b IS NULL").select("cell", F.col("a").alias("fp"), F.floor(F.col("place") / limit).cast("int").alias("own"))
    last = large.groupBy("cell").agg(F.max("own").alias("last"))
    dealt = large.join(last, "cell").withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).filter("own <> other")
    pairs = dealt.groupBy("cell", F.least("own", "other"), F.greatest("own", "other")).applyInArrow(_block(radius), "a bigint, b bigint")
    return found.filter("b IS NOT NULL").select("a", "b").unionAll(pairs)


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of docs.

    A-Z become lower case, words are what ASCII white space divides, and a text's shingles are all its runs of `width` words, repeats included, joined by
    blanks; fewer words are one shingle. A bit of the fingerprint (16 hexadecimal digits) is 1 if over half the XXH64 hashes (seed 42) of the
    shingles have it, so a tie gives 0. Fingerprints with at most `radius` differing bits link, and a component is what links reach, named by its
    smallest doc_id.

    Null and empty texts and those without words have the fingerprint zero and link like others. A null doc_id is a document that links; it never
    names a component unless all ids of the component are null. Rows that repeat an id are documents of their own. Texts are read whole, whatever
    their length, in steps of bounded memory. An empty table gives no rows. Other columns play no part.
    """
    rows = texts(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    named = rows.select(F.struct("doc_id").alias("row"), "text").mapInArrow(_fingerprints(width), f"row struct<doc_id:{kind}>, fp bigint")
    prints = stored(named.select("row.doc_id", "fp"))
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    found = components(links(fps.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("top"))
    of = fps.join(found, "fp").groupBy("top").agg(F.min("low").alias("lowest"))
    named = stored(fps.join(found.join(of, "top").select("fp", "lowest", F.lit(True).alias("linked")), "fp", "left").select(
        "fp", "n", F.when(F.col("linked"), F.col("lowest")).otherwise(F.col("low")).alias("component_id")))
    # A fingerprint of over a thousandth of all rows is looked up in a broadcast table, of a thousand rows at most; the others meet by shuffle.
    many = F.broadcast(named.filter(F.col("n") * 1000 > F.lit(prints.count())).select("fp", "component_id"))
    both = prints.join(many, "fp").unionAll(prints.join(many, "fp", "left_anti").join(named.select("fp", "component_id"), "fp"))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
