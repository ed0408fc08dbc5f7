"""Packing of token streams into windows of several lengths."""

from __future__ import annotations

import bisect
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import by_bytes, texts

SLICE = 2 << 20  # bytes of text tokenized and packed at a time


class WordCache:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    The vocabulary's pre-tokenizer never joins what white space divides, so each piece between white space is encoded by the library once and
    then remembered. A piece of letters, or of letters and then signs, is one or two words to the pre-tokenizer; these are remembered by
    themselves, in lower case, and sent to the library many at a time: where one ends its last id has the word-end mark. Other pieces are sent
    with a character between them whose id no other piece can end in. White space here is what the library takes for it; a text with a
    character that only Python divides at, or with that character, is encoded by itself.
    """

    MARK, ALONE = "\0", "\0\x1c\x1d\x1e\x1f"
    SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")  # letters with one lower case each
    SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one worker per core
        from tokenizers import Tokenizer
        self.tool, self.known, self.words, self.most = Tokenizer.from_file(path), {}, {"": b""}, 0
        self.mark = self.tool.encode(self.MARK, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the vocabulary has no id of its own for the mark")
        self.ends = np.zeros(self.tool.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tool.get_vocab().items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4")

    def batches(self, found: list[str], most: int = 2000) -> Iterator[tuple[str, bytes]]:
        """Pieces of any kind, with the mark between them."""
        for i in range(0, len(found), most):
            some = found[i:i + most]
            ids = self.encode(f" {self.MARK} ".join(some))
            ends = np.flatnonzero(ids == self.mark[0])
            data, bounds = ids.tobytes(), [0, *(4 * ends + 4).tolist()]
            yield from zip(some, [data[x:y] for x, y in zip(bounds, [*(4 * ends).tolist(), len(data)])], strict=True)

    def single(self, found: list[str], most: int = 2000) -> Iterator[tuple[str, bytes]]:
        """Words of the pre-tokenizer."""
        for i in range(0, len(found), most):
            some = found[i:i + most]
            ids = self.encode(" ".join(some))
            data, bounds = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            yield from zip(some, [data[x:y] for x, y in zip(bounds, bounds[1:])], strict=True)

    def learn(self, new: set[str]) -> None:
        split, rest = [], []
        for piece in new:
            letters = piece.rstrip(self.SIGNS)
            if letters.isalpha() and (letters.isascii() or self.SIMPLE.fullmatch(letters)):
                split.append((piece, letters.lower(), piece[len(letters):]))
            else:
                rest.append(piece)
        parts = {x for _, *two in split for x in two}
        words = self.words
        if len(words) + len(parts) > self.most:
            words.clear()
            words[""] = b""
        words.update(self.single(list(parts.difference(words))))
        self.known.update([(piece, words[letters] + words[signs]) for piece, letters, signs in split])
        self.known.update(self.batches(rest))

    def texts(self, found: list[str]) -> list[bytes]:
        get, rows, new = self.known.get, [], set()
        for t in found:
            if any(c in t for c in self.ALONE):
                rows.append(([], [self.encode(t).tobytes()], []))
                continue
            pieces = t.split()
            ids = list(map(get, pieces))
            holes = [i for i, x in enumerate(ids) if x is None]
            new.update([pieces[i] for i in holes])
            rows.append((pieces, ids, holes))
        if len(self.known) + len(new) > self.most:
            self.known.clear()
        self.learn(new)
        for pieces, ids, holes in rows:
            for i in holes:
                ids[i] = self.known[pieces[i]]
        return [b"".join(ids) for _, ids, _ in rows]


@functools.cache
def cache(path: str) -> WordCache:
    return WordCache(path)


class Packer:
    """Packs documents as they come; what does not fill a window waits for the next ones.

    A document longer than the largest window gives whole windows first; its rest goes to the smallest tier that holds it. Windows are opened
    from the largest tier down, one for each piece; the gap is filled with the longest waiting pieces that fit whole, shorter tiers only as long
    as they have any, then by cutting one piece. Full windows only are closed before the end.
    """

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = sorted(tiers)
        self.wait: list[list] = [[] for _ in tiers]  # by tier, sorted by length
        self.closed: list[tuple[int, list]] = []
        self.added = 0

    def _put(self, piece: tuple) -> None:
        """piece: (length, arrival, start, document)"""
        bisect.insort(self.wait[bisect.bisect_left(self.tiers, piece[0])], piece)

    def add(self, document, n: int) -> None:
        most, at = self.tiers[-1], 0
        while n - at >= most:
            self.closed.append((most, [(most, self.added, at, document)]))
            self.added += 1
            at += most
        if n > at:
            self._put((n - at, self.added, at, document))
            self.added += 1

    def _fill(self, gap: int, tier: int) -> list:
        """Pieces for a gap in a window of the tier; fewer than the gap only if nothing waits."""
        got = []
        order = [*range(tier - 1, -1, -1), tier]
        while gap:
            for t in order:
                if at := bisect.bisect_right(self.wait[t], (gap, float("inf"))):
                    got.append(self.wait[t].pop(at - 1))
                    break
            else:
                t = next((t for t in order if self.wait[t]), None)
                if t is None:
                    break
                length, arrival, start, document = self.wait[t].pop(0)
                got.append((gap, arrival, start, document))
                self._put((length - gap, arrival, start + gap, document))
            gap -= got[-1][0]
        return got

    def close(self, last: bool = False) -> list[tuple[int, list]]:
        """The windows closed so far; at the end the rest too, cut at powers of two so that it needs no padding."""
        for t in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[t]
            while self.wait[t]:
                first = self.wait[t].pop()
                pieces = [first, *self._fill(size - first[0], t)]
                if sum(p[0] for p in pieces) < size:  # nothing else waits
                    for p in pieces:
                        self._put(p)
                    break
                self.closed.append((size, pieces))
        if last:
            rest = [p for w in self.wait for p in w]
            self.wait = [[] for _ in self.tiers]
            total = sum(p[0] for p in rest)
            size = 1 << total.bit_length()
            while rest:
                size >>= 1
                if total & size:
                    room, pieces = size, []
                    while room:
                        length, arrival, start, document = rest.pop()
                        take = min(room, length)
                        pieces.append((take, arrival, start, document))
                        room -= take
                        if take < length:
                            rest.append((length - take, arrival, start + take, document))
                    self.closed.append((size, pieces))
        out, self.closed = self.closed, []
        return out


def step_groups(windows: list[tuple[int, list]], step_tokens: int, first: int) -> tuple[list[int], int]:
    """A group for each window and the next free group: windows of one length, about step_tokens in each.

    Windows are dealt in order of their attention cost (the sum of squared piece lengths) to and fro over the groups, so that groups cost alike.
    """
    group, by_size = [0] * len(windows), {}
    for i, (size, pieces) in enumerate(windows):
        by_size.setdefault(size, []).append((-sum(p[0] ** 2 for p in pieces), i))
    for size in sorted(by_size):
        own = sorted(by_size[size])
        n = -(-len(own) // max(1, step_tokens // size))
        for k, (_, i) in enumerate(own):
            lap, at = divmod(k, n)
            group[i] = first + (n - 1 - at if lap % 2 else at)
        first += n
    return group, first


FIELDS = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint"


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, step_tokens: int = 16384,
         remember: int = 800_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, tier (window length), step_group.

    Each partition of the input is packed by itself: no shuffle, no key that could be hot, and a lost task is simply run again (its input comes
    from the same split; sequence_id starts with the partition's number). A worker holds one slice of text, less than one open window, and the
    ids of at most `remember` pieces and as many words, which trades memory for speed. Windows are full; the rest of a partition is cut into windows of falling powers of two, so nothing needs padding.

    A null or empty text is its end id alone. Documents of any length are packed whole. Repeated rows are packed once each, equal lengths in the
    order of arrival. A null doc_id is kept. An empty table gives no rows.
    """
    ids = texts(docs, id_col, text_col)
    schema = f"doc_id {dict(ids.dtypes)['doc_id']}, {FIELDS}"
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", *[x.split()[0] for x in FIELDS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, packer, base = cache(tokenizer), Packer(tiers), TaskContext.get().partitionId() << 33
        tool.most = remember
        kind, numbers = None, [0, 0]

        def rows(windows):
            groups, numbers[1] = step_groups(windows, step_tokens, numbers[1])
            cols: list[list] = [[] for _ in names]
            for group, (size, pieces) in zip(groups, windows):
                at = 0
                for length, _, start, (key, data) in pieces:
                    for col, x in zip(cols, (key, start, length, data[4 * start:4 * (start + length)], len(data) // 4, base + numbers[0], at, size, base + group)):
                        col.append(x)
                    at += length
                numbers[0] += 1
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in by_bytes(batches, SLICE):
            kind = batch.column("doc_id").type
            for key, data in zip(batch.column("doc_id").to_pylist(), tool.texts(batch.column("text").to_pylist())):
                packer.add((key, data + end), len(data) // 4 + 1)
            if windows := packer.close():
                yield rows(windows)
        if windows := packer.close(last=True):
            yield rows(windows)

    return ids.mapInArrow(run, schema)
