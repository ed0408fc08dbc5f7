"""Token counts by byte-pair merging on a heap and a linked list."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from .common import by_bytes, texts

CACHE = 400_000  # words a task remembers; when full it starts afresh


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself where printable, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class BytePairCounter:
    """Counts what a byte-level BPE vocabulary with word ends makes of a text, without making identifiers.

    Symbols are the bytes of a word, the last one with the word-end mark. The adjacent pair of the lowest rank is merged, the leftmost of equal
    ranks first; each merge makes one symbol fewer, so the count is the number of symbols minus the merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        # Of white space, the library knows the Unicode property only; Python adds four control characters.
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        added = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        # Symbols as numbers: a pair's entry holds its rank and the merged symbol.
        number = model["vocab"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[number[a], number[b]] = (rank, number[a + b])
        symbols = byte_symbols()
        self.inner = [number[s] for s in symbols]
        self.last = [number[s + self.end] for s in symbols]
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def word(self, word: str) -> int:
        data = word.encode("utf-8")
        n = len(data)
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if n == 1:
            return 1
        merges, before, after = self.merges, list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found[0], i, symbols[i], symbols[i + 1], found[1]) for i in range(n - 1) if (found := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != left or symbols[j] != right:  # one side was merged meanwhile
                continue
            done += 1
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((merged, symbols[k])):
                    heapq.heappush(heap, (found[0], i, merged, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((symbols[h], merged))):
                heapq.heappush(heap, (found[0], h, symbols[h], merged, found[1]))
        return n - done

    def plain(self, text: str) -> int:
        """A text without added tokens."""
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
        total = 0
        for w in self.pattern.findall(text):
            n = self.words.get(w)
            if n is None:
                if len(self.words) >= CACHE:
                    self.words.clear()
                n = self.words[w] = self.word(w)
            total += n
        return total

    def whole(self, text: str) -> int:
        if self.added is None:
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def count(self, text: str) -> int:
        """White space ends every word, so each piece between white space counts alone and is remembered."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        pieces, known, total = text.split(), self.chunks, 0
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = self.whole(p)
                if len(p) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[p] = n
            total += n
        return total


@functools.cache
def counter(path: str) -> BytePairCounter:
    return BytePairCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document, repeated ones too, without a shuffle.

    `vocabulary` is the path of a tokenizer file that every executor can open. Null and empty texts count 0; texts of any length are counted
    whole; added tokens inside texts count one each; an empty table gives no rows.
    """
    ids = texts(docs, id_col, text_col)
    kind = pa.int64() if dict(ids.dtypes)["doc_id"] == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(vocabulary)
        for batch in by_bytes(batches, 4 << 20):
            found = batch.column("text")
            n = [tool.count(t) for t in found.to_pylist()]
            key = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([key.cast(kind) if kind else key, pa.compute.binary_length(found).cast(pa.int64()), pa.array(n, pa.int64()),
                                              pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        tool.words.clear()
        tool.chunks.clear()

    return ids.mapInArrow(run, f"doc_id {dict(ids.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
