"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, ship, texts

CACHE = 200_000  # pieces between white space a task remembers; when full it starts afresh
# Scripts written without spaces: Thai to Lao, Burmese, Khmer, kana, Han. Each of their characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
SHORTEST = 2  # words; one word alone stands in too many clean texts to prove anything
BASE = 1_000_003
MASK = (1 << 61) - 1  # modulus of the running hash, a prime


@functools.cache
def _known() -> dict[str, bytes]:
    return {}


def tokens(found: list[str]) -> list[np.ndarray]:
    """The words of each whole text, lower case, as 64-bit hashes; pieces between white space are remembered."""
    known, out = _known(), []
    for t in found:
        pieces = t.split()
        for p in set(pieces).difference(known):
            if len(known) >= CACHE:
                known.clear()
            known[p] = b"".join(xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")).to_bytes(8, "little") for w in WORD.findall(p.lower()))
        try:
            data = b"".join(map(known.__getitem__, pieces))
        except KeyError:  # cleared meanwhile
            data = b"".join(xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")).to_bytes(8, "little") for w in WORD.findall(t.lower()))
        out.append(np.frombuffer(data, "<u8"))
    return out


def seeds(words: np.ndarray, least: int) -> np.ndarray:
    """A hash of every run of `least` words, by place."""
    n = len(words) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(least):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (words[i:i + n] ^ (words[i:i + n] >> np.uint64(29)))
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def windows(values: list[int], used: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of each window of `size` values none of which is used, hashed by rolling."""
    top, h, run = pow(BASE, size - 1, MASK), 0, 0
    for i, v in enumerate(values):
        if used[i]:
            h = run = 0
            continue
        if run == size:
            h = (h - values[i - size] * top) % MASK
            run -= 1
        h = (h * BASE + v) % MASK
        run += 1
        if run == size:
            yield i - size + 1, h


def tiles(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping (place in doc, place in item, length) of equal stretches, longest first, `least` values at least.

    Each round hashes the unmarked windows of one size in the item, looks up those of the document, and marks the matches found, longest first;
    what an earlier mark has cut is kept where it is still as long as the size. The size falls to `least`; a match of more than twice the size
    starts the round again with that length.
    """
    out, size = [], max(least, min(len(item), len(doc)) // 2)
    used_d, used_i = [False] * len(doc), [False] * len(item)
    while True:
        places: dict[int, list[int]] = {}
        for j, h in windows(item, used_i, size):
            places.setdefault(h, []).append(j)
        found, longest = [], 0
        for i, h in windows(doc, used_d, size) if places else ():
            for j in places.get(h, ()):
                if i and j and doc[i - 1] == item[j - 1] and not used_d[i - 1] and not used_i[j - 1]:
                    continue  # part of the match that began one place before
                k = 0
                while i + k < len(doc) and j + k < len(item) and not used_d[i + k] and not used_i[j + k] and doc[i + k] == item[j + k]:
                    k += 1
                if k >= size:
                    found.append((k, i, j))
                    longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for k, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if any(used_d[i:i + k]) or any(used_i[j:j + k]):
                again = True
                continue
            used_d[i:i + k] = used_i[j:j + k] = [True] * k
            out.append((i, j, k))
        if again:
            continue  # what is left of them may still hold matches of this size
        if size <= least:
            return out
        size = max(least, size // 2)


class Benchmark:
    """The items' words and seeds, for a benchmark of checked size."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int):
        self.items, self.least = items, least
        # Items too short for a seed are found as a whole: by length, the seeds in order and their items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(SHORTEST, least):
            of_size = [k for k, (_, w) in enumerate(items) if len(w) == size]
            if of_size:
                whole = np.concatenate([seeds(items[k][1], size) for k in of_size])
                order = np.argsort(whole, kind="stable")
                self.short[size] = whole[order], np.array(of_size)[order]
        all_seeds = [seeds(w, least) for _, w in items]
        self.seed = np.concatenate([*all_seeds, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(items)), [len(s) for s in all_seeds])
        self.place = np.concatenate([*[np.arange(len(s)) for s in all_seeds], np.zeros(0, int)])
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]
        # Most words of a document lie in no seed; a table of bits answers that at once.
        self.size = np.uint64(max(1 << 10, 1 << (len(self.seed) * 32).bit_length()) - 1)
        self.bits = np.zeros(int(self.size) + 1, bool)
        self.bits[(self.seed & self.size).astype(np.int64)] = True

    def hits(self, words: np.ndarray, least_share: float) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item, coverage, tiles) of the items that the document covers enough."""
        yield from self._short_hits(words)
        yield from self._long_hits(words, least_share)

    def _short_hits(self, words: np.ndarray) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        for size, (seed, item) in self.short.items():
            own, at = np.unique(seeds(words, size), return_index=True)
            left, right = np.searchsorted(seed, own, "left"), np.searchsorted(seed, own, "right")
            for n in np.flatnonzero(right > left):
                for k in item[left[n]:right[n]]:
                    yield self.items[k][0], 1.0, [(int(at[n]), 0, size)]

    def _long_hits(self, words: np.ndarray, least_share: float) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        own = seeds(words, self.least)
        at = np.flatnonzero(self.bits[(own & self.size).astype(np.int64)])
        if not len(at):
            return
        left, right = np.searchsorted(self.seed, own[at], "left"), np.searchsorted(self.seed, own[at], "right")
        at, left, right = at[right > left], left[right > left], right[right > left]
        if not len(at):
            return
        # Of equal seeds of the document one is enough to know which items and places they reach.
        first = np.unique(left, return_index=True)[1]
        reach = np.concatenate([np.arange(a, b) for a, b in zip(left[first], right[first])])
        for k in np.unique(self.item[reach]):
            key, item = self.items[k]
            covered = np.zeros(len(item), bool)
            for p in self.place[reach[self.item[reach] == k]]:
                covered[p:p + self.least] = True
            if covered.sum() < least_share * len(item):  # no tiling covers more than the seeds do
                continue
            mine = at[np.isin(own[at], self.seed[self.item == k])]
            keep = np.zeros(len(words) + 1, bool)
            for i in range(self.least):
                keep[mine + i] = True
            where = np.flatnonzero(keep)
            # Stretches of the document that share seeds, one value between them that no item holds.
            doc, back, last = [], [], None
            for p in where.tolist():
                if last is not None and p != last + 1:
                    doc.append(-1)
                    back.append(-1)
                doc.append(int(words[p]) % MASK)
                back.append(p)
                last = p
            found = tiles(doc, [int(x) % MASK for x in item], self.least)
            coverage = sum(t[2] for t in found) / len(item)
            if coverage >= least_share:
                yield key, coverage, [(back[i], j, n) for i, j, n in found]


OUT = "coverage double, n_tiles bigint, longest bigint, tiles array<struct<doc_start:bigint,item_start:bigint,length:bigint>>"
TILE = pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))


def _batch(keys: list, key_type, items: list, item_type, found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(keys, key_type), pa.array(items, item_type), pa.array([c for c, _ in found], pa.float64()), pa.array([len(t) for _, t in found], pa.int64()),
        pa.array([max(x[2] for x in t) for _, t in found], pa.int64()),
        pa.array([[{"doc_start": i, "item_start": j, "length": n} for i, j, n in t] for _, t in found], TILE)],
        names=["doc_id", "item_id", "coverage", "n_tiles", "longest", "tiles"])


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("item_text"))


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5, most_bytes: int = 32 << 20, id_col: str = "doc_id",
                  item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest, tiles: the pairs in which tiles of `least` words or more cover `share` of the item.

    Passages count in whatever order they stand. Words are runs of letters, digits and underscores, in lower case; in scripts written without
    spaces each character is one. An item with fewer than `least` words, but two at least, is found where it stands whole. A benchmark whose text is at
    most `most_bytes` (it is measured) goes to every task, and documents need no shuffle. A larger one is joined with the documents on shared
    seeds, first by ids, then with the texts of the pairs found; the result is the same.

    Items of one word, with null or empty text, are never found; null and empty documents neither. Texts are searched whole.
    Repeated rows of a document give repeated pairs in the first way; in both, pairs with a null doc_id or item_id are given as they are.
    """
    ids = texts(docs, id_col, text_col)
    items = _items(benchmark, item_col, text_col)
    kind, item_kind = dict(ids.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, {OUT}"
    if _bytes(items) > most_bytes:
        return _by_join(ids, items, least, share, schema)
    rows = items.collect()  # of measured size
    table = [(r.item_id, r.item_text) for r in rows]
    item_type = pa.int64() if item_kind == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(list(zip([k for k, _ in table], tokens([t for _, t in table]))), least)
        for b in by_bytes(batches, 2 << 20):
            keys, hit, found = [], [], []
            for key, words in zip(b.column("doc_id").to_pylist(), tokens(b.column("text").to_pylist())):
                for item, coverage, spans in bench.hits(words, share):
                    keys.append(key)
                    hit.append(item)
                    found.append((coverage, spans))
            if keys:
                yield _batch(keys, b.column("doc_id").type, hit, item_type, found)
        _known().clear()

    return ids.mapInArrow(run, schema)


def _by_join(ids: DataFrame, items: DataFrame, least: int, share: float, schema: str) -> DataFrame:
    """For a benchmark too large to send about."""

    def length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 2 << 20, "item_text"):
            yield pa.RecordBatch.from_arrays([pa.array([min(len(w), least) for w in tokens(b.column("item_text").to_pylist())], pa.int32())], names=["size"])

    lengths = items.select("item_text").mapInArrow(length, "size int").filter(F.col("size") >= min(SHORTEST, least)).distinct()
    sizes = sorted(r.size for r in lengths.collect())  # `least` of them at most

    def seeded(key: str, text: str, whole: bool):
        """Seeds of the lengths that items have; of an item only those of its own length (`whole`)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in by_bytes(batches, 2 << 20, text):
                found = [np.unique(np.concatenate([np.zeros(0, np.uint64), *[seeds(w, n) for n in sizes if not whole or n == min(len(w), least)]])).astype("<i8")
                         for w in tokens(b.column(text).to_pylist())]
                at = np.repeat(np.arange(b.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at)), pa.array(np.concatenate([*found, np.zeros(0, "<i8")]))], names=[key, "seed"])
        return run

    own = ids.mapInArrow(seeded("doc_id", "text", False), f"doc_id {dict(ids.dtypes)['doc_id']}, seed bigint")
    theirs = items.mapInArrow(seeded("item_id", "item_text", True), f"item_id {dict(items.dtypes)['item_id']}, seed bigint")
    pairs = own.join(theirs, "seed").select("doc_id", "item_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 2 << 20):
            keys, hit, found = [], [], []
            for key, item, words, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "item_id")], tokens(b.column("text").to_pylist()), b.column("item_text").to_pylist()):
                for name, coverage, spans in Benchmark([(item, tokens([text])[0])], least).hits(words, share):
                    keys.append(key)
                    hit.append(name)
                    found.append((coverage, spans))
            if keys:
                yield _batch(keys, b.column("doc_id").type, hit, b.column("item_id").type, found)

    pairs = pairs.select(F.col("doc_id").alias("doc"), F.col("item_id").alias("item"))
    both = pairs.join(ids, F.col("doc").eqNullSafe(F.col("doc_id"))).join(items, F.col("item").eqNullSafe(F.col("item_id"))).select("doc_id", "text", "item_id", "item_text")
    return both.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5, most_bytes: int = 32 << 20, id_col: str = "doc_id",
                      item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, in which `contamination` finds no item.

    Each row is decided by its own text, whatever its id is. With a benchmark of at most `most_bytes` there is no shuffle; a larger one is
    joined with the different texts, which go by their SHA-256 and so are never null.
    """
    ship(docs.sparkSession)
    items = _items(benchmark, item_col, text_col)
    if _bytes(items) > most_bytes:
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        ids = docs.select(F.sha2(text, 256).alias("doc_id"), text.alias("text")).dropDuplicates(["doc_id"])
        found = _by_join(ids, items, least, share, f"doc_id string, item_id {dict(items.dtypes)['item_id']}, {OUT}").select("doc_id").distinct()
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(text, 256).alias("doc_id"))
        return rows.join(found, "doc_id", "left_anti").select("row.*")
    table = [(r.item_id, r.item_text) for r in items.collect()]  # of measured size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(list(zip([k for k, _ in table], tokens([t for _, t in table]))), least)
        for b in by_bytes(batches, 2 << 20, text_col):
            clean = [next(bench.hits(words, share), None) is None for words in tokens([t or "" for t in b.column(text_col).to_pylist()])]
            yield b.filter(pa.array(clean, pa.bool_()))
        _known().clear()

    return docs.mapInArrow(run, docs.schema)
