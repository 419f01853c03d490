"""Suffix arrays by induced sorting, in whole-bucket steps of numpy, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

from assayflow.llm.hashing import mix, powers

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; s ends with a sentinel below all else."""
    n = len(s)
    step = np.sign(np.diff(s))
    decided = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(decided[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.append(step, 1)[nxt] > 0
    return out


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    """Positions of suffixes smaller than the next whose predecessor is not."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by key, each ordered item's rank among equals, the keys and their counts. Keys of 16 bits are sorted by radix."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    counts = np.diff(np.append(start, len(keys)))
    return order, np.arange(len(keys)) - np.repeat(start, counts), ordered[start], counts


def induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order all suffixes from the order of the leftmost smaller ones (seeds), bucket by bucket.

    Suffixes larger than their successor come up through the buckets, then the smaller ones down. A bucket's
    members that bring in others of the same bucket (runs of a byte) do so in waves.
    """
    sizes = np.bincount(s)
    end = np.cumsum(sizes)
    begin = end - sizes
    sa = np.full(len(s), -1, np.int64)
    seed_bucket = s[seeds]  # ascending
    seed_begin = np.searchsorted(seed_bucket, np.arange(len(sizes)))
    seed_end = np.searchsorted(seed_bucket, np.arange(len(sizes)), "right")
    used = np.flatnonzero(sizes)
    head = begin.copy()
    for c in used:
        at = begin[c]
        while True:
            wave = sa[at : head[c]]
            at = head[c]
            seeded = not len(wave)
            if seeded:
                wave = seeds[seed_begin[c] : seed_end[c]]
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                order, rank, keys, counts = runs(s[before])
                sa[np.repeat(head[keys], counts) + rank] = before[order]
                head[keys] += counts
            if seeded:
                break
    tail = end.copy()
    sa[0] = len(s) - 1
    for c in used[::-1]:
        at = end[c]
        while True:
            wave = sa[tail[c] : at][::-1]
            at = tail[c]
            last = not len(wave)
            if last:
                wave = sa[begin[c] : head[c]][::-1]
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                order, rank, keys, counts = runs(s[before])
                sa[np.repeat(tail[keys], counts) - 1 - rank] = before[order]
                tail[keys] -= counts
            if last:
                break
    sa[0] = len(s) - 1
    return sa


class Spans:
    """Hashes of spans of a string, equal for equal spans."""

    def __init__(self, s: np.ndarray):
        self.sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(mix(s.astype(np.uint64)) * powers(_BASE, len(s)), out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(s) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def all(self, size: int) -> np.ndarray:
        """Of each span of that size, by its start."""
        return (self.sums[size:] - self.sums[: len(self.sums) - size]) * self.inverse[: len(self.sums) - size]


def name_order(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names: pairs of names are named again, until all differ or depth names count.

    A rank is the place of the first of those that are alike so far; only what isn't told apart yet is sorted again.
    """
    n, reach = len(names), 1
    alike, key, rank = np.arange(n), names.astype(np.int64), np.zeros(n, np.int64)
    while len(alike):
        by = np.argsort(key)
        alike, key = alike[by], key[by]
        old, at = rank[alike], np.arange(len(alike))
        first = np.append(True, key[1:] != key[:-1])
        begin = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        rank[alike] = old + np.maximum.accumulate(np.where(first, at, 0)) - begin
        if reach >= depth:
            break
        alike = alike[~(first & np.append(first[1:], True))]
        nxt = np.where(alike + reach < n, rank[np.minimum(alike + reach, n - 1)] + 1, 0)
        key = rank[alike] * (n + 2) + nxt
        reach *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of bytes, right for their first `depth` bytes at least; the empty suffix is left out."""
    s = np.append(data.astype(np.int16) + np.int16(1), np.int16(0))
    if len(s) < 3:
        return np.arange(len(s) - 1)
    smaller = types(s)
    lms = leftmost_smaller(smaller)
    order = lms[np.argsort(s[lms], kind="stable")]
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    found = induce(s, smaller, order)
    order = found[is_lms[found]]  # leftmost smaller substrings in order
    stop = np.zeros(len(s), np.int64)
    stop[lms] = np.append(lms[1:] + 1, len(s))
    spans = Spans(s)
    h, size = spans.of(order, stop[order]), stop[order] - order
    name = np.zeros(len(s), np.int64)
    name[order] = np.cumsum(np.append(False, (h[1:] != h[:-1]) | (size[1:] != size[:-1])))
    order = lms[name_order(name[lms], -(-depth // 2))]  # a name stands for two bytes at least
    return induce(s, smaller, order)[1:]


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each position, how many bytes (limit at most) its suffix shares with the one before it in order.

    Kept by position and not by order, as the comparison runs over the text; it halves the length in doubt
    at each step, on hashes of spans.
    """
    n = len(data)
    spans = Spans(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.flatnonzero(before >= 0)
    other, got = before[own], np.zeros(len(own), np.int64)
    room = np.minimum(limit, n - np.maximum(own, other))
    step = 1 << max(0, limit.bit_length() - 1)
    while step:
        if step <= n:
            spanned = spans.all(step)
            same = spanned[np.minimum(own + got, n - step)] == spanned[np.minimum(other + got, n - step)]
            got += step * (same & (got + step <= room))
        step >>= 1
    out = np.zeros(n, np.int64)
    out[own] = got
    return out


def group_firsts(data: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """For each place with a position (others are negative): does the string of `length` bytes there also start at a smaller position?"""
    sa = suffix_array(data, length)
    shares = permuted_prefixes(data, sa, length)[sa] >= length
    start = np.flatnonzero(~shares)
    never = np.iinfo(np.int64).max
    placed = position[sa]
    placed[placed < 0] = never
    first = np.repeat(np.minimum.reduceat(placed, start), np.diff(np.append(start, len(sa))))
    out = np.zeros(len(data), bool)
    out[sa] = (placed > first) & (placed != never)
    return out


