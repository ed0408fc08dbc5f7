"""The trie of shared conversation beginnings, built as adaptive radix trees over the ids of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

WIDTH = 16  # bytes of a turn's id
ENDS = 1 << 16  # conversation ids of one piece of a list of ends
NODE = ("node binary, parent binary, slice int, open boolean, parent_open boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, said bigint, once bigint, ends_sha256 string, piece bigint, ends string")


class Leaf:
    """A whole key: what lies below its parent's byte is not spelled out in nodes."""
    __slots__ = ("key", "sizes", "convs")

    def __init__(self, key: bytes, sizes: np.ndarray, conv: int):
        self.key, self.sizes, self.convs = key, sizes, [conv]


class Inner:
    """A node of the radix tree. `path` are the compressed bytes before it branches; `own` is the leaf of the key that ends here.

    The layout grows with the children: up to 16 sorted bytes with their children beside them (4, then 16), an index of 256 places into 48 children,
    and 256 children.
    """
    __slots__ = ("path", "own", "room", "bytes", "index", "children")

    def __init__(self, path: bytes):
        self.path, self.own, self.room, self.bytes, self.index, self.children = path, None, 4, bytearray(), None, []

    def find(self, byte: int):
        if self.room <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.room == 48:
            at = self.index[byte]
            return self.children[at] if at < 48 else None
        return self.children[byte]

    def put(self, byte: int, child) -> None:
        """Sets the child of a byte, new or known."""
        if self.room <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.children[at] = child
                return
            if len(self.children) == self.room:
                self._grow()
                return self.put(byte, child)
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.children.insert(at, child)
        elif self.room == 48:
            if self.index[byte] < 48:
                self.children[self.index[byte]] = child
                return
            if len(self.children) == 48:
                self._grow()
                return self.put(byte, child)
            self.index[byte] = len(self.children)
            self.children.append(child)
        else:
            self.children[byte] = child

    def _grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            self.room, self.index = 48, bytearray([255]) * 256
            for at, byte in enumerate(self.bytes):
                self.index[byte] = at
            self.bytes = bytearray()
        else:
            self.room, self.children = 256, [self.children[at] if at < 48 else None for at in self.index]
            self.index = None

    def ordered(self) -> list:
        if self.room == 48:
            return [self.children[at] for at in self.index if at < 48]
        return [c for c in self.children if c is not None]


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


class Tree:
    def __init__(self):
        self.root = None

    def insert(self, key: bytes, sizes: np.ndarray, conv: int) -> None:
        if self.root is None:
            self.root = Leaf(key, sizes, conv)
            return
        above, byte, node, at = None, 0, self.root, 0
        while True:
            path = node.key[at:] if isinstance(node, Leaf) else node.path
            same = _shared(path, key[at:at + len(path)])
            if isinstance(node, Leaf) and same == len(path) and at + same == len(key):
                node.convs.append(conv)
                return
            if isinstance(node, Leaf) or same < len(path):  # the path branches here
                fork = Inner(path[:same])
                if same < len(path):
                    fork.put(path[same], node)
                    if isinstance(node, Inner):
                        node.path = path[same + 1:]
                else:
                    fork.own = node
                if above is None:
                    self.root = fork
                else:
                    above.put(byte, fork)
                node = fork
            at += len(node.path)
            if at == len(key):
                if node.own is None:
                    node.own = Leaf(key, sizes, conv)
                else:
                    node.own.convs.append(conv)
                return
            above, byte, child = node, key[at], node.find(key[at])
            if child is None:
                node.put(byte, Leaf(key, sizes, conv))
                return
            node, at = child, at + 1


class Open:
    """A trie node whose subtree is being read."""
    __slots__ = ("node", "depth", "size", "old", "on_first", "conv", "convs", "children", "leaves", "said", "once", "ends", "waiting")

    def __init__(self, node: bytes, depth: int, size: int, on_first: bool, old: bool):
        self.node, self.depth, self.size, self.on_first, self.old = node, depth, size, on_first, old
        self.conv, self.convs, self.children, self.leaves, self.said, self.once, self.ends, self.waiting = None, 0, 0, 0, 0, 0, (), []


def _digest(above: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(above + turn).digest()


class Reading:
    """The trie nodes of a slice of sorted keys, read from its radix tree in order; only depths of whole turns give nodes.

    before: the turns that the slice's first key shares with the slice before it, or -1; after: those that its last key shares with the next slice, or -1.
    Nodes that other slices hold too are open: their numbers are this slice's part. A node counts as a child, and its text once, in the slice that has it
    first; a childless one counts as a leaf in the slice that has it last.
    """

    def __init__(self, tree: Tree, part: int, before: int, after: int, last: bytes):
        self.tree, self.part, self.before, self.after, self.last = tree, part, before, after, last
        self.stack: list[Open] = []
        self.at_end = {}  # digests of the last key's open nodes by depth
        node = b""
        for d in range(after + 1):
            node = _digest(node, last[(d - 1) * WIDTH:d * WIDTH] if d else b"")
            self.at_end[d] = node

    def leaves(self) -> Iterator[tuple[Leaf, bool]]:
        """The keys in order, and whether longer ones begin with them."""
        todo = [(self.tree.root, False)]
        while todo:
            item, extended = todo.pop()
            if isinstance(item, Leaf):
                yield item, extended
                continue
            todo.extend((c, False) for c in reversed(item.ordered()))
            if item.own is not None:
                todo.append((item.own, True))

    def enter(self, turn: bytes, size: int, on_first: bool) -> None:
        depth = len(self.stack)
        node = _digest(self.stack[-1].node if depth else b"", turn)
        self.stack.append(Open(node, depth, size, on_first, on_first and depth <= self.before))

    def leave(self) -> Iterator[tuple]:
        x = self.stack.pop()
        shared = x.old or self.at_end.get(x.depth) == x.node
        x.said += x.convs * x.size
        x.once += 0 if x.old else x.size
        sha = None if shared else hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest()
        row = [x.node, None, self.part, shared, False, x.conv, x.depth, None, x.convs, x.children, x.leaves, x.said, x.once, sha, None, None]
        for child in x.waiting:
            child[1], child[4], child[7] = x.node, shared, None if shared else x.conv
            yield tuple(child)
        for k in range(0, len(x.ends) if shared else 0, ENDS):
            yield x.node, None, self.part, True, False, None, x.depth, None, 0, 0, 0, 0, 0, None, k, ",".join(map(str, x.ends[k:k + ENDS]))
        if not self.stack:
            yield tuple(row)
            return
        up = self.stack[-1]
        up.waiting.append(row)
        up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
        up.convs += x.convs
        up.children += not x.old
        up.leaves += x.leaves
        up.said += x.said
        up.once += x.once

    def rows(self) -> Iterator[tuple]:
        previous = None
        for leaf, extended in self.leaves():
            depth, first = len(leaf.key) // WIDTH, previous is None
            if first:
                self.enter(b"", 0, True)
            else:
                while len(self.stack) > _shared(previous, leaf.key) // WIDTH + 1:
                    yield from self.leave()
            for d in range(len(self.stack) - 1, depth):
                self.enter(leaf.key[d * WIDTH:(d + 1) * WIDTH], int(leaf.sizes[d]), first)
            end, previous = self.stack[-1], leaf.key
            end.convs += len(leaf.convs)
            end.conv = leaf.convs[0] if end.conv is None else min(end.conv, leaf.convs[0])
            end.ends = leaf.convs
            end.leaves += not extended and not (leaf.key == self.last and self.after == depth)
        while self.stack:
            yield from self.leave()


FIELDS = [("node", pa.binary()), ("parent", pa.binary()), ("slice", pa.int32()), ("open", pa.bool_()), ("parent_open", pa.bool_()), ("conv_id", pa.int64()),
          ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("said", pa.int64()),
          ("once", pa.int64()), ("ends_sha256", pa.string()), ("piece", pa.int64()), ("ends", pa.string())]


def _nodes(bounds: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def given(rows: Iterator[tuple], least: int) -> Iterator[pa.RecordBatch]:
            for row in rows:
                held.append(row)
                if len(held) >= least:
                    yield batch()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), FIELDS)], names=[n for n, _ in FIELDS])
            held.clear()
            return out

        tree, part, key = Tree(), None, b""
        for b in batches:
            for own, key_, sizes, conv in zip(b.column("slice").to_pylist(), b.column("key"), b.column("sizes"), b.column("conv_id").to_pylist()):
                if own != part:
                    if part is not None:
                        yield from given(Reading(tree, part, *bounds[part], key).rows(), 4096)
                    tree, part = Tree(), own
                key = key_.as_py()
                tree.insert(key, np.frombuffer(sizes.as_buffer(), "<i8"), conv)
        if part is not None:
            yield from given(Reading(tree, part, *bounds[part], key).rows(), 4096)
        if held:
            yield batch()
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from its turns in order: their ids and their numbers of characters, joined."""
    conv, key, sizes = None, bytearray(), bytearray()
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.binary(), pa.binary()))], names=["conv_id", "key", "sizes"])
        done.clear()
        return out

    held = 0
    for b in batches:
        for c, turn, n in zip(b.column("conv_id").to_pylist(), b.column("id").to_pylist(), b.column("chars").to_pylist()):
            if c != conv and conv is not None:
                done.append((conv, bytes(key), bytes(sizes)))
                held += len(key)
                key, sizes = bytearray(), bytearray()
                if held > 1 << 20:
                    yield batch()
                    held = 0
            conv = c
            key += turn
            sizes += n.to_bytes(8, "little")
    if conv is not None:
        done.append((conv, bytes(key), bytes(sizes)))
        yield batch()


def _turns_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [None if y.as_py() is None else _shared(x.as_py(), y.as_py()) // WIDTH for x, y in zip(b.column("last"), b.column("next"))]
        yield pa.RecordBatch.from_arrays([b.column("slice"), pa.array(n, pa.int64())], names=["slice", "shared"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each node, which follow each other."""
    node, state, done = None, None, []
    for b in batches:
        for own, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist()):
            if own != node:
                done += [(node, state.hexdigest())] if state else []
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends.encode())
    done += [(node, state.hexdigest())] if state else []
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["node", "ends_sha256"])


def keys(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, key, sizes: the 16-byte ids of a conversation's turns in order, joined, and the characters of each text as 8 bytes, little-endian."""
    ship(conversations.sparkSession)
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.select(F.col(f"`{id_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                                 F.unhex(F.substring(digest, 1, 2 * WIDTH)).alias("id"), F.length(text).cast("bigint").alias("chars")).filter("conv_id IS NOT NULL")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "id").mapInArrow(_keys, "conv_id bigint, key binary, sizes binary")


def share_beginnings(own: DataFrame, every: int, begins: Column, most: int) -> DataFrame:
    """keys (a stored table) in which each conversation c begins with the first `begins` turns, at most `most`, of conversation c - c % every.

    Its own turns after its first `begins` follow. An absent conversation gives no turns; the remainder is never negative.
    """
    base = own.filter(F.pmod("conv_id", F.lit(every)) == 0).select(
        F.col("conv_id").alias("first"), F.substring("key", 1, most * WIDTH).alias("first_key"), F.substring("sizes", 1, most * 8).alias("first_sizes"))
    joined = own.withColumn("h", begins.cast("int")).withColumn("first", F.col("conv_id") - F.pmod("conv_id", F.lit(every))).join(base, "first", "left")

    def mixed(name: str, width: int) -> Column:
        return F.expr(f"concat(coalesce(substring(first_{name}, 1, {width} * h), X''), substring({name}, 1 + {width} * h))").alias(name)

    return joined.select("conv_id", mixed("key", WIDTH), mixed("sizes", 8))


def trie(keyed: DataFrame, slice_bytes: int = 8 << 20, most: int = 1 << 20) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node of the trie of keyed (`keys`).

    A node is a distinct sequence of first turns, the root the empty one; its members are the conversations that begin with it. conv_id is the
    smallest member, parent_conv_id the parent's (null for the root); n_leaves are the childless nodes of its subtree, itself included; saved_tokens
    sums (members - 1) times the characters of the last text over its subtree; ends_sha256 is of the ids of members that end there, ascending and
    joined by commas.

    1. Keys, with ids below them, are cut into sorted slices of about `slice_bytes`, so a beginning or a whole conversation that very many share lies in
       many slices. What neighbours share is one number per slice on the driver.
    2. A task builds the adaptive radix tree of a slice, reads it in order and gives the nodes at depths of whole turns.
    3. Nodes on the borders of slices are summed over slices. All numbers add up, as nodes are counted once by the slice that has them first or last.

    Rows without a conversation's id belong to none and are left out; null roles and texts are empty, null turns come first; turns of equal number go by
    the digest of role and text; repeated rows are turns of their own. An empty table gives no rows. Texts of any length are digested where they lie;
    a conversation's key is one value (16 bytes a turn). Other columns play no part.
    """
    spark = keyed.sparkSession
    total = keyed.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    parts = keyed.repartitionByRange(max(1, -(-total // slice_bytes)), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    placed = stored(parts.withColumn("slice", F.spark_partition_id()))
    edges = placed.groupBy("slice").agg(F.min("key").alias("first"), F.max("key").alias("last")).coalesce(1).sortWithinPartitions("slice")  # one row per slice
    following = edges.selectExpr("slice", "last", "lead(first) OVER (ORDER BY slice) AS next").mapInArrow(_turns_shared, "slice int, shared bigint")
    bounds, before = {}, -1
    for part, shared in sorted(following.collect()):
        bounds[part] = (before, -1 if shared is None else shared)
        before = bounds[part][1]
    nodes = stored(placed.repartition("slice").sortWithinPartitions("slice", "key", "conv_id").mapInArrow(_nodes(bounds), NODE))
    counts = ["n_convs", "n_children", "n_leaves", "said", "once"]
    cut = nodes.filter("open")
    ends = cut.filter("ends IS NOT NULL").select("node", "slice", "piece", "ends").repartition("node").sortWithinPartitions("node", "slice", "piece").mapInArrow(
        _streamed, "node binary, ends_sha256 string")
    merged = cut.groupBy("node").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in counts])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    merged = stored(merged.join(ends, "node", "left").select("parent", "node", "conv_id", "depth", *counts, F.coalesce("ends_sha256", nothing).alias("ends_sha256")))
    ids = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    if merged.count() <= most:
        ids = F.broadcast(ids)
    columns = ["conv_id", "depth", *counts, "ends_sha256"]
    inner = nodes.filter("NOT open")
    below = inner.filter("parent_open").select("parent", *columns).unionAll(merged.select("parent", *columns)).join(ids, "parent", "left")
    out = inner.filter("NOT parent_open").select(*columns, "parent_conv_id").unionAll(below.select(*columns, F.col("above").alias("parent_conv_id")))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("said") - F.col("once")).alias("saved_tokens"), "ends_sha256")
