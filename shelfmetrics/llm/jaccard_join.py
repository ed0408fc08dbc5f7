"""Near duplicates by Jaccard similarity of word shingles, found by PartEnum signatures."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, ship, stored, texts
from .components import components

CACHE = 200_000  # words a task remembers; when full it starts afresh
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BLOCK, BLOCK_BYTES = 512, 4 << 20  # members of a star, and bytes of their sets, that one task compares with as many others
SLICE = 1 << 20  # bytes of text that a task holds as sets at once


@functools.cache
def _known() -> dict[bytes, bytes]:
    return {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * SPREAD
    return (x ^ (x >> np.uint64(29))) * MIX


def _hash(word: bytes) -> bytes:
    return xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes.

    A-Z become lower case; words are what ASCII white space divides; a text of fewer than `width` words has one shingle, all of them; none has none.
    """
    known, words = _known(), text.encode("utf-8", "replace").translate(LOWER).split()
    if len(known) > CACHE:
        known.clear()
    known.update((w, _hash(w)) for w in set(words).difference(known))
    a = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u8")
    if not len(a):
        return a
    n = max(1, len(a) - width + 1)
    h = np.full(n, min(len(a), width), np.uint64)
    for i in range(min(width, len(a))):
        h = (h ^ (h >> np.uint64(31))) * MIX + a[i:i + n]
    return np.unique(mixed(h))


class Plan(NamedTuple):
    """Similarity num / den. Sizes fall into bands; parts and subsets follow from the largest difference two similar sets of a band can have."""
    num: int
    den: int
    parts: int = 2  # second-level parts of a partition
    spare: int = 1  # of which so many may differ

    def similar(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Whether the sets, sorted, have the similarity."""
        both = np.concatenate((x, y))
        both.sort(kind="stable")
        both = int((both[1:] == both[:-1]).sum())
        return self.den * both >= self.num * (len(x) + len(y) - both)

    def apart(self, total: int) -> int:
        """The largest symmetric difference of two similar sets whose sizes add up to total."""
        return total * (self.den - self.num) // (self.den + self.num)

    def band(self, n: int) -> int:
        edges = band_edges(self.num, self.den)
        return int(np.searchsorted(edges, n, "right")) - 1

    def keys(self, n: int) -> list[int]:
        """The bands of a set: its own, and the next one if that holds sets large enough to be similar."""
        own = self.band(n)
        return [own, own + 1] if n * self.den // self.num >= band_edges(self.num, self.den)[own + 1] else [own]

    def partitions(self, band: int) -> int:
        least = -(-(self.apart(2 * (int(band_edges(self.num, self.den)[band + 1]) - 1)) + 1) // (self.spare + 1))
        return least + 1 + least // 16  # some more than needed, as some stay empty


@functools.cache
def band_edges(num: int, den: int) -> np.ndarray:
    """1, and each next one by the third power of den / num, up to more shingles than a text can have."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * den ** 3 // num ** 3)))
    return np.array(edges, np.int64)


def signatures(found: np.ndarray, plan: Plan) -> np.ndarray:
    """Signatures of a set such that two sets of at least the similarity share one.

    Features fall into partitions of `parts` parts each. Similar sets differ in so few features that some partition holds at most `spare` of
    the differences; then all but `spare` of its parts are equal, and the subset of these parts is a signature of both. Subsets that hold no
    feature are left out. That can only lose a pair when differences fill so many parts as this set occupies at the most; such a set (and then
    its partner too) also gives each feature as a signature.
    """
    out = []
    n = len(found)
    for band in plan.keys(n):
        count = plan.partitions(band)
        part = ((found >> np.uint64(11)) % np.uint64(count * plan.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at = part[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sums = np.zeros(count * plan.parts, np.uint64)
        sums[at[first]] = np.add.reduceat(mixed(found[order]), first)
        full = np.zeros(count * plan.parts, bool)
        full[at] = True
        sums, full = sums.reshape(count, plan.parts), full.reshape(count, plan.parts)
        place = np.arange(count, dtype=np.uint64) + np.uint64(band << 32)
        for k, chosen in enumerate(itertools.combinations(range(plan.parts), plan.parts - plan.spare)):
            h = place * SPREAD + np.uint64(k + 1)
            for c in chosen:
                h = mixed(h) + sums[:, c]
            out.append(mixed(h)[full[:, list(chosen)].any(axis=1)])
        most = min(n * plan.den // plan.num, int(band_edges(plan.num, plan.den)[band + 1]) - 1)
        if np.minimum(full.sum(axis=1), plan.spare + 1).sum() <= plan.apart(n + max(n, most)):
            out.append(mixed(found + np.uint64(band)) ^ SPREAD)
    return np.concatenate(out)


def _signature_rows(width: int, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, SLICE):
            first: dict[bytes, int] = {}
            docs, sigs, other, same = [], [], [], []
            for doc, text in sorted(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())):
                found = shingles(text, width)
                if not len(found):
                    continue
                kept = first.setdefault(found.tobytes(), doc)
                if kept != doc:  # an equal set in this slice: one link, no signatures
                    other.append(doc)
                    same.append(kept)
                    continue
                own = signatures(found, plan)
                sigs.append(own)
                docs.append(np.full(len(own), doc, np.int64))
            a, s = np.concatenate([*docs, np.array(other, np.int64)]), np.concatenate([*sigs, mixed(np.array(other, np.int64).view(np.uint64))]).view(np.int64)
            none = np.arange(len(a)) < len(a) - len(other)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(a), pa.array(np.concatenate([np.zeros(len(a) - len(other), np.int64), np.array(same, np.int64)]), pa.int64(), mask=none)],
                                             names=["sig", "doc_id", "same"])
        _known().clear()
    return run


def sketch(found: np.ndarray) -> np.ndarray:
    """A byte for each of 2 ** p cells, at least half as many as features: the sum of the features that fall there.

    A feature that one of two sets lacks changes one cell, so sets differ in as many features as cells at least.
    """
    cells = 1 << max(0, int(len(found) - 1).bit_length() - 1)
    h = mixed(found ^ SPREAD)
    return np.bincount((h >> np.uint64(8)).astype(np.int64) & (cells - 1), ((h & np.uint64(255)) | np.uint64(1)).astype(np.int64), cells).astype(np.int64).astype(np.uint8)


def folded(x: np.ndarray, cells: int) -> np.ndarray:
    """Sketches (in the last dimension) over fewer cells."""
    return x.reshape(*x.shape[:-1], -1, cells).sum(axis=-2, dtype=np.uint8)


def _heads(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, SLICE):
            found = [shingles(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary()),
                pa.array([sketch(f).tobytes() for f in found], pa.binary())], names=["doc_id", "size", "print", "sketch"])
        _known().clear()
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, SLICE):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingles(t, width).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "found"])
        _known().clear()
    return run


def _near(plan: Plan):
    """The pairs whose sketches allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, x, y in zip(*[b.column(c).to_pylist() for c in ("size_a", "size_b", "sketch_a", "sketch_b")]):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                cells = min(len(x), len(y))
                keep.append(bool((folded(x, cells) != folded(y, cells)).sum() <= plan.apart(n + m)))
            at = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([at.column("a"), at.column("b")], names=["a", "b"])
    return run


def _linked(plan: Plan):
    """The pairs that are similar by their whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 8 << 20, "found_a"):
            keep = []
            for x, y in zip(b.column("found_a").to_pylist(), b.column("found_b").to_pylist()):
                keep.append(plan.similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")))
            at = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([at.column("a"), at.column("b")], names=["a", "b"])
    return run


def _pairs(plan: Plan, size: np.ndarray, root: np.ndarray, sketches: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Members, each with the later ones of other roots (as they are by then) whose sketches allow the similarity."""
    cells = np.array([len(x) for x in sketches])
    # As the similarity is at least a half, similar sets have as many cells or twice as many.
    for own in np.unique(cells):
        at = np.flatnonzero((cells == own) | (cells == 2 * own))
        x = np.stack([folded(sketches[i], own) for i in at])
        for k, i in enumerate(at.tolist()):
            others = np.arange(k + 1, len(at))
            others = others[((cells[i] == own) | (cells[at[others]] == own)) & (root[at[others]] != root[i])]
            apart = (size[at[others]] + size[i]) * (plan.den - plan.num) // (plan.den + plan.num)
            able = np.abs(size[at[others]] - size[i]) <= apart
            others, apart = others[able], apart[able]
            yield i, at[others[(x[others] != x[k]).sum(axis=1) <= apart]]


def _able(plan: Plan):
    """The members of a block, or of two blocks, of a star that their sketches allow to be similar to one of another label."""
    def run(table: pa.Table) -> pa.Table:
        size, label = (table.column(c).to_numpy() for c in ("size", "label"))
        some = np.zeros(len(size), bool)
        for i, others in _pairs(plan, size, label, [np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()]):
            some[others] = True
            some[i] |= len(others) > 0
        return table.select(["centre", "i", "j", "doc_id", "label"]).filter(pa.array(some))
    return run


def _block(plan: Plan):
    """Links (a, b) between the labels of members of a block, or of two blocks, of a star: pairs of different labels whose sketches allow the similarity are
    compared by their whole sets, and what a link joins is not compared again. Each label is linked to the smallest one it is joined with, so there are
    fewer links than labels, and stars of the same members give the same ones.
    """
    def run(table: pa.Table) -> pa.Table:
        label = table.column("label").to_numpy()
        found = [np.frombuffer(x, "<u8") for x in table.column("found").to_pylist()]
        root = label.copy()
        for i, others in _pairs(plan, np.array([len(f) for f in found]), root, [sketch(f) for f in found]):
            for n in others.tolist():
                if root[n] != root[i] and plan.similar(found[i], found[n]):
                    low, high = sorted((root[n], root[i]))
                    root[root == high] = low
        out = np.unique(np.stack([label, root])[:, label != root], axis=1)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})
    return run


def _few(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A stored table of one id column, marked for broadcast if it is counted to have at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc_id, found: the sets of the documents of a stored table of ids; only these are made and stored."""
    return stored(docs.join(_few(ids), "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id bigint, found binary"))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, plan: Plan) -> DataFrame:
    """The pairs (a, b), stored, whose whole sets are similar."""
    own = _sets_of(stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()), docs, width)
    left, right = [own.select(F.col("doc_id").alias(c), F.col("found").alias(f"found_{c}")) for c in ("a", "b")]
    return pairs.join(left, "a").join(right, "b").mapInArrow(_linked(plan), "a bigint, b bigint")


def _labelled(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The edges (a, b) between the labels of their ends, those inside one label left out."""
    for c in ("a", "b"):
        edges = edges.join(label.select(F.col("node").alias(c), F.col("component").alias(f"label_{c}")), c, "left")
    a, b = [F.coalesce(f"label_{c}", c) for c in ("a", "b")]
    return edges.select(*[c for c in edges.columns if not c.startswith("label_")], a.alias("label_a"), b.alias("label_b")).filter("label_a <> label_b")


def _joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """node, component after further links (a, b) between labels or nodes without one."""
    top = components(more).select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = label.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = top.select(F.col("component").alias("node"), F.col("top").alias("component")).join(label.select("node"), "node", "left_anti")
    return stored(old.unionAll(new))


def similar_components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """node, component: the components of the graph of similar pairs of documents (doc_id, text), by their smallest id; those without a link are not listed.

    Documents that share a signature form a star around the smallest of them.

    1. Each document is compared with the centre with which it shares most signatures: by sketch, and by whole sets if the sketches allow the
       similarity. Equal sets are linked by their hash.
    2. So are pairs of a document and another of its centres that are not yet in one component.
    3. Members of a star that are not in one component may still be similar to each other. A star is cut into blocks; tasks of bounded size compare the
       sketches of two blocks and name the members that may have a partner, then the whole sets of these, and join labels as they find links.

    No list of pairs is larger than the memberships of stars, and sets are made only of documents that sketches leave.
    """
    plan = Plan(num, den)
    if 2 * num < den:
        raise ValueError("the similarity must be at least a half")
    docs = docs.filter("doc_id IS NOT NULL")
    rows = docs.mapInArrow(_signature_rows(width, plan), "sig bigint, doc_id bigint, same bigint")
    lowest = F.min("doc_id").over(Window.partitionBy("sig"))
    stars = stored(rows.select("doc_id", F.coalesce("same", lowest).alias("centre"), F.col("same").isNotNull().alias("equal"))
                   .filter("doc_id <> centre").groupBy("doc_id", "centre", "equal").agg(F.count("*").alias("n")))
    candidates = stars.filter("not equal")
    nodes = stored(candidates.select("doc_id").union(candidates.select("centre")).distinct())
    heads = stored(docs.join(_few(nodes), "doc_id", "left_semi").mapInArrow(_heads(width), "doc_id bigint, size bigint, print binary, sketch binary"))
    left, right = [heads.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}"), F.col("print").alias(f"print_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b")]
    able = (F.col("print_a") != F.col("print_b")) & (F.abs(F.col("size_a") - F.col("size_b")) * (den + num) <= (F.col("size_a") + F.col("size_b")) * (den - num))

    def similar(pairs: DataFrame) -> DataFrame:
        near = pairs.join(left, "a").join(right, "b").filter(able).mapInArrow(_near(plan), "a bigint, b bigint")
        return _verified(stored(near), docs, width, plan)

    best = candidates.groupBy("doc_id").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("centre"))
    # Equal sets: the smallest document stands for all.
    one = heads.groupBy("print").agg(F.min("doc_id").alias("first"))
    equal = heads.join(one, "print").filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    nearest = similar(best.select(F.col("centre").alias("a"), F.col("doc_id").alias("b")))
    label = components(stars.filter("equal").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).union(equal).union(nearest))
    # Centres further away, where they may join something.
    other = candidates.join(best.withColumnRenamed("centre", "done"), "doc_id").filter("centre <> done").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    further = similar(_labelled(other, label).select("a", "b"))
    label = _joined(label, _labelled(further, label).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    # The centre has been compared with all members, so the members are compared among themselves, equal sets once.
    members = candidates.select("doc_id", "centre").join(heads.select("doc_id", "size"), "doc_id").join(one.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").join(
        label.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left").select("centre", "doc_id", "size", F.coalesce("label", "doc_id").alias("label"))
    bulk = members.groupBy("centre").agg(F.count("*").alias("n"), (F.sum("size") * 8).alias("bytes"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    # Members of one label lie in up to 64 blocks, so that many pairs of blocks have one label only and are left out.
    own = F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("doc_id"), F.lit(64))), F.col("blocks")).cast("int")
    dealt = members.join(bulk.select("centre", blocks.alias("blocks")), "centre").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "centre", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "label")
    several = dealt.groupBy("centre", "i", "j").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("centre", "i", "j")
    rest = dealt.join(several, ["centre", "i", "j"]).join(heads.select("doc_id", "size", "sketch"), "doc_id")
    rest = stored(rest.groupBy("centre", "i", "j").applyInArrow(_able(plan), "centre bigint, i int, j int, doc_id bigint, label bigint"))
    sets = _sets_of(stored(rest.select("doc_id").distinct()), docs, width)
    inside = rest.join(sets, "doc_id").groupBy("centre", "i", "j").applyInArrow(_block(plan), "a bigint, b bigint")
    return _joined(label, stored(inside.distinct()))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs.

    Two documents are linked when the Jaccard similarity of their sets of `width`-word shingles is at least num / den; a component is what links
    reach, named by its smallest doc_id. Ids are integers. Texts without words, empty or null, have no shingles and stay alone; a null id stays
    alone with a null component. Rows of one id are one document with the links of each of its texts. An empty table gives no rows.
    """
    ids = texts(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, SLICE):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(shingles(t, width)) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "n_shingles"])
        _known().clear()

    found = similar_components(ids, width, num, den).withColumnRenamed("node", "doc_id")
    return ids.mapInArrow(sizes, "doc_id bigint, n_shingles bigint").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, without those whose text links join to the text of a smaller id: one text of each group stays.

    Texts are the nodes, by their 64-bit hash, so ids may be null (after all others), repeated or of any type with an order, and a row stays or goes by
    its own text; rows of equal text stay or go together (`drop_copies` leaves one of them). Null and empty texts and those without words have no
    shingles and stay, texts of any length are compared whole, an empty table gives no rows, and the names of other columns do not matter.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    node = F.xxhash64(text)
    found = similar_components(docs.select(node.alias("doc_id"), text.alias("text")), width, num, den)
    ids = docs.select(node.alias("node"), F.col(f"`{id_col}`").alias("id")).join(_few(found), "node")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "node"))["node"].alias("kept"))
    gone = stored(found.join(first, "component").filter("node <> kept").select(F.col("node").alias("doc_id")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node.alias("doc_id"))
    return rows.join(_few(gone), "doc_id", "left_anti").select("row.*")
