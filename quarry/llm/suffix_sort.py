"""Suffix sorting by compared hashes.

Prefix polynomial hashes give the hash of any substring in constant time, so the
longest common extension of two suffixes is a binary search, a comparison is
logarithmic in their length, and a mergesort needs n log n of them. All merges
of a level run together as array operations. Afterwards the bytes of all
neighbours are compared; should two different strings have had one hash, the sort
is done again with another base.
"""

from __future__ import annotations

import functools

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 to the 64, and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Hashed:
    """Bytes with their prefix hashes."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        n = len(data)
        power, self.inverse = _powers(base, 1 << max(16, n.bit_length()))
        self.data = data
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.prefix[1:])

    def windows(self, length: int) -> np.ndarray:
        """The hash of every substring of one length."""
        n = len(self.data) - length + 1
        return (self.prefix[length:] - self.prefix[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)

    def at(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extensions of the suffixes at a and b, up to `most`."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            l, h = low[open_], high[open_]
            mid = (l + h + 1) >> 1
            same = self.at(a[open_], mid) == self.at(b[open_], mid)
            low[open_] = np.where(same, mid, l)
            high[open_] = np.where(same, h, mid - 1)


def sorted_suffixes(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes data[start : start + length] within their groups, and each one's common length with the one before.

    `group` ascends. The order is stable; the common length of a group's first
    suffix is -1.
    """
    for base in BASES:
        hashed = Hashed(data, base)
        order = _mergesort(hashed, start, length, group)
        common = np.full(len(order), -1, np.int64)
        p, q = order[:-1], order[1:]
        same = np.flatnonzero(group[p] == group[q])
        if len(same):
            common[same + 1] = hashed.common(start[p[same]], start[q[same]], np.minimum(length[p[same]], length[q[same]]))
        if _verified(data, start, length, order, common):
            return order, common
    raise ValueError("every base gave equal hashes to different strings")


def _verified(data, start, length, order, common) -> bool:
    """By bytes: neighbours agree as far as their hashes do and are in order at the next byte."""
    at = np.flatnonzero(common >= 0)
    for begin in range(0, len(at), 1 << 16):
        k = at[begin : begin + (1 << 16)]
        p, q, c = order[k - 1], order[k], common[k]
        a, b = start[p], start[q]
        for t in range(int(c.max(initial=0))):
            live = c > t
            if not np.array_equal(data[a[live] + t], data[b[live] + t]):
                return False
        more = (c < length[p]) & (c < length[q])
        if np.any(data[a[more] + c[more]] >= data[b[more] + c[more]]) or np.any(~more & (length[p] > length[q])):
            return False
    return True


def _less(h: Hashed, start, length, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 per pair of suffixes."""
    most = np.minimum(length[i], length[j])
    c = h.common(start[i], start[j], most)
    out = np.sign(length[i] - length[j])
    k = np.flatnonzero(c < most)
    if len(k):
        a, b = h.data[start[i[k]] + c[k]].astype(np.int64), h.data[start[j[k]] + c[k]].astype(np.int64)
        out[k] = np.sign(a - b)
    return out


def _mergesort(h: Hashed, start, length, group) -> np.ndarray:
    n = len(start)
    order = np.arange(n)
    if n < 2:
        return order
    first = np.searchsorted(group, group, side="left")
    last = np.searchsorted(group, group, side="right")
    width = 1
    while width < n:
        mid = np.arange(width, n, 2 * width)
        mid = mid[group[mid - 1] == group[mid]]  # other runs are in order
        if len(mid):
            low = np.maximum(first[mid], mid - width)
            high = np.minimum(last[mid], mid + width)
            sizes = high - low
            run = np.repeat(np.arange(len(mid)), sizes)
            pos = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[run]
            left = pos < mid[run]
            me = order[pos]
            # each looks for its rank in the other run; equal ones of the left run come first
            lo, hi = np.where(left, mid[run], low[run]), np.where(left, high[run], mid[run])
            base = lo.copy()
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                m = (lo[open_] + hi[open_]) >> 1
                c = _less(h, start, length, order[m], me[open_])
                before = np.where(left[open_], c < 0, c <= 0)
                lo[open_] = np.where(before, m + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], m)
            rank = lo - base
            to = np.where(left, pos + rank, pos - (mid[run] - low[run]) + rank)
            merged = order.copy()
            merged[to] = me
            order = merged
        width *= 2
    return order
