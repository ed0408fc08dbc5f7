"""Suffix arrays by induced sorting, and their permuted common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one, and the places of the leftmost smaller ones.

    The last symbol is the only one of its kind and the smallest; its suffix counts as smaller."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    # Where equal symbols follow, the next change decides.
    change = np.where(step != 0, np.arange(n - 1), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = step[np.minimum(change, n - 2)] > 0
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, left


def _induce_symbols(s: np.ndarray, larger: np.ndarray, left: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order from the leftmost smaller ones in order; few symbols.

    A bucket's entries induce entries of the same and of later buckets only. So a bucket is taken as a whole: numpy places what it induces, and
    what falls into the bucket itself is the next block.
    """
    n = len(s)
    order = np.full(n, -1, np.int64)
    count = np.bincount(s, minlength=symbols)
    tail = np.cumsum(count)
    head = tail - count
    # Larger suffixes from the front; each bucket's larger part, then its leftmost smaller suffixes.
    own = s[left]
    seeds = left[np.argsort(own, kind="stable")]
    bound = np.searchsorted(s[seeds], np.arange(symbols + 1))
    fill = head.copy()

    def place(block: np.ndarray, larger_ones: bool) -> None:
        before = block - 1
        before = before[before >= 0]
        before = before[larger[before] == larger_ones]
        if not len(before):
            return
        c = s[before]
        by = np.argsort(c, kind="stable")
        c, before = c[by], before[by]
        many = np.bincount(c, minlength=symbols)
        rank = np.arange(len(c)) - (np.cumsum(many) - many)[c]
        if larger_ones:
            order[fill[c] + rank] = before
            fill[:] += many
        else:
            order[fill[c] - 1 - rank] = before
            fill[:] -= many

    for b in np.flatnonzero(count):
        at = head[b]
        while at < fill[b]:
            at, block = fill[b], order[at:fill[b]]
            place(block, True)
        if bound[b] < bound[b + 1]:
            place(seeds[bound[b]:bound[b + 1]], True)
    ends = fill.copy()  # of the larger parts
    fill = tail.copy()
    order[0] = n - 1  # the last symbol's suffix comes first
    fill[s[n - 1]] = 0
    for b in np.flatnonzero(count)[::-1]:
        at = tail[b]
        while at > fill[b] and b != s[n - 1]:
            at, block = fill[b], order[fill[b]:at][::-1]
            place(block, False)
        if head[b] < ends[b]:
            place(order[head[b]:ends[b]][::-1], False)
    return order


def _induce_names(s: list[int], larger: list[bool], left: list[int], symbols: int) -> list[int]:
    """The same for many symbols, entry by entry."""
    n = len(s)
    count = np.bincount(s, minlength=symbols)
    tail = np.cumsum(count)
    head = (tail - count).tolist()
    tail = tail.tolist()
    order = [-1] * n
    end = tail.copy()
    for i in reversed(left):
        end[s[i]] -= 1
        order[end[s[i]]] = i
    fill = head
    for i in order:  # sees what is written ahead
        j = i - 1
        if j >= 0 and larger[j]:
            c = s[j]
            order[fill[c]] = j
            fill[c] += 1
    # Leftmost smaller suffixes make room: all smaller ones are placed again from the back.
    end = tail
    for i in reversed(order):
        j = i - 1
        if j >= 0 and not larger[j]:
            c = s[j]
            end[c] -= 1
            order[end[c]] = j
    order[0] = n - 1
    return order


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Places of the suffixes of s in order. s ends in 0, which stands nowhere else; other values are 1 to symbols - 1.

    Suffixes are classified; sorting the substrings between leftmost smaller suffixes (by inducing from unsorted ones) gives them names; the
    string of names, at most half as long, is sorted by recursion unless all names differ; from the order of the leftmost smaller suffixes all
    others are induced in linear time.
    """
    s = np.asarray(s)
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller, left = suffix_types(s)
    if symbols <= 512:
        def induce(some: np.ndarray) -> np.ndarray:
            return _induce_symbols(s, ~smaller, some, symbols)
    else:
        values, larger = s.tolist(), (~smaller).tolist()

        def induce(some: np.ndarray) -> np.ndarray:
            return np.array(_induce_names(values, larger, some.tolist(), symbols), np.int64)
    if len(left) > 1:
        is_left = np.zeros(n, bool)
        is_left[left] = True
        order = induce(left)
        sorted_left = order[is_left[order]]
        following = np.full(n, n - 1)
        following[left[:-1]] = left[1:]
        length = following[sorted_left] - sorted_left + 1
        new = np.ones(len(left), bool)  # differs from the one before
        same = np.flatnonzero(length[1:] == length[:-1]) + 1
        a, b, k, at = sorted_left[same - 1], sorted_left[same], length[same], 0
        while len(same):
            ended = k == at
            new[same[ended]] = False
            go = ~ended
            go[go] = s[a[go] + at] == s[b[go] + at]
            same, a, b, k, at = same[go], a[go], b[go], k[go], at + 1
        names = np.zeros(n, np.int64)
        names[sorted_left] = np.cumsum(new) - 1
        number = int(names[sorted_left[-1]]) + 1
        if number < len(left):
            sorted_left = left[suffix_array(names[left], number)]
    else:
        sorted_left = left
    return induce(sorted_left)


def common_prefixes(s: np.ndarray, order: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of s the place whose suffix comes before, and the length of their common prefix, which ends before any value <= stop.

    Values are found in the order of places: where the symbols before a suffix and before its predecessor are equal the prefix is one shorter
    than that of the place before, so only the other places are compared.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    left = np.where((place > 0) & (before > 0), s[place - 1], -1)
    alike = (left == s[np.maximum(before - 1, 0)]) & (left > stop) & (before > 0)
    start = np.flatnonzero(~alike & (before >= 0))
    length = np.zeros(n, np.int64)
    # Four symbols at a time; values up to stop are made to differ from each other.
    ends = s <= stop
    apart = np.where(ends, 600 + np.cumsum(ends) % 64000, s).astype(np.uint64)
    apart = np.concatenate([apart, np.arange(65100, 65104, dtype=np.uint64)])
    words = apart[:n] | apart[1:n + 1] << np.uint64(16) | apart[2:n + 2] << np.uint64(32) | apart[3:n + 3] << np.uint64(48)
    i, j, k = start, before[start], np.zeros(len(start), np.int64)
    open_ = start
    while len(open_):
        inside = (i < n) & (j < n)
        equal = inside.copy()
        equal[inside] = words[i[inside]] == words[j[inside]]
        done = ~equal
        if done.any():
            x, y, m = i[done], j[done], k[done]
            for _ in range(3):
                more = (x < n) & (y < n)
                more[more] = apart[x[more]] == apart[y[more]]
                x, y, m = x + more, y + more, m + more
            # A place that differs once differs for good: later steps of it compare the same symbols again.
            length[open_[done]] = m
        open_, i, j, k = open_[equal], i[equal] + 4, j[equal] + 4, k[equal] + 4
    base = np.maximum.accumulate(np.where(~alike, place, 0))
    length = np.where(alike, length[base] - (place - base), length)
    return before, length
