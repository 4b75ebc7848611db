"""Sorting suffixes by comparing hashes of their prefixes.

Prefix polynomial hashes (modulo 2^64) give the hash of any stretch by one subtraction and product.
The longest common extension of two suffixes is found by binary search over equal hashes, so two suffixes compare in
logarithmic time; a mergesort with these comparisons, over all groups of suffixes at once, sorts them. Afterwards every
two neighbours are compared byte by byte: a collision can't go unseen, and a group with one is sorted by its bytes.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Suffixes whose bytes are laid side by side at a time.
ROWS = 1 << 15

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; the longest table asked for is kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(steps)
    return known[:n]


class Hashed:
    """A text of bytes with its prefix hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        values = self.prefix[1:]
        values += data
        values += np.uint64(1)
        values *= powers(BASE, len(data))
        np.cumsum(values, out=values)
        self.scale = powers(INVERSE, len(data) + 1)

    def stretch(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The hash of data[start : start + length], wherever it stands."""
        return (self.prefix[start + length] - self.prefix[start]) * self.scale[start]

    def bytes_at(self, start: np.ndarray, length: int) -> np.ndarray:
        """The bytes of data[start : start + length], a row for each start."""
        every = np.ndarray((len(self.data) - length + 1,), f"V{length}", np.ascontiguousarray(self.data), strides=(1,))
        return every[start].view(np.uint8).reshape(len(start), length)

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all stretches of one size, mixed so that every bit depends on every byte."""
        h = (self.prefix[size:] - self.prefix[:-size]) * self.scale[: max(0, len(self.data) - size + 1)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
        return h

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Length of the longest common extension of suffixes a and b, at most ``limit``."""
        out = np.full(len(a), limit)
        open_ = np.flatnonzero(self.stretch(a, limit) != self.stretch(b, limit))
        a, b = a[open_], b[open_]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit - 1)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.stretch(a, middle) == self.stretch(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[open_] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Whether suffix a, cut to ``limit`` bytes, stands before suffix b."""
        size = self.common(a, b, limit)
        last = np.minimum(size, limit - 1)
        return (size < limit) & (self.data[a + last] < self.data[b + last])


def sort_suffixes(text: Hashed, at: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): suffixes by group and then by their first ``limit`` bytes (all have that many), and
    whether each has the same group and bytes as the one before it.

    Suffixes of a group with the same hash of these bytes are sorted as one, once their bytes have been compared; if two differ all the
    same, all are sorted one by one.
    """
    whole = text.stretch(at, limit)
    by_hash = np.lexsort((whole, group))
    copy = np.zeros(len(at), bool)
    copy[1:] = (group[by_hash[1:]] == group[by_hash[:-1]]) & (whole[by_hash[1:]] == whole[by_hash[:-1]])
    again = np.flatnonzero(copy)
    for i in range(0, len(again), ROWS):
        k = again[i : i + ROWS]
        if (text.bytes_at(at[by_hash[k - 1]], limit) != text.bytes_at(at[by_hash[k]], limit)).any():
            return _sort_each(text, at, group, limit)
    starts = np.flatnonzero(~copy)
    one = by_hash[starts]
    order, _ = _sort_each(text, at[one], group[one], limit)
    sizes = np.diff(np.append(starts, len(at)))[order]
    heads = np.cumsum(sizes) - sizes
    same = np.ones(len(at), bool)
    same[heads] = False
    return by_hash[np.repeat(starts[order] - heads, sizes) + np.arange(len(at))], same


def _sort_each(text: Hashed, at: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by a mergesort of all suffixes."""
    order = np.argsort(group, kind="stable")
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(order)))
    width = 1
    while len(sizes) and width < sizes.max():
        _merge(text, at, order, starts[sizes > width], sizes[sizes > width], width, limit)
        width *= 2
    return _verified(text, at, order, starts, sizes, new, limit)


def _merge(text: Hashed, at: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, limit: int) -> None:
    """Merge neighbouring sorted runs of ``width`` within each group, in place."""
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    local = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    here = first + local
    run = local // width
    right = run % 2 == 1
    other = np.minimum((run ^ 1) * width, size)
    low, high = first + other, first + np.minimum(other + width, size)
    begin, mine = low.copy(), order[here]
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        theirs, own = at[order[middle]], at[mine[open_]]
        # A left suffix goes behind smaller right ones, a right one behind left ones that aren't larger.
        swap = right[open_]
        a, b = np.where(swap, own, theirs), np.where(swap, theirs, own)
        ahead = text.less(a, b, limit) != swap
        low[open_] = np.where(ahead, middle + 1, low[open_])
        high[open_] = np.where(ahead, high[open_], middle)
    order[first + (run // 2) * 2 * width + local % width + (low - begin)] = mine


def _verified(text, at, order, starts, sizes, new, limit) -> tuple[np.ndarray, np.ndarray]:
    same = np.zeros(len(order), bool)
    wrong = np.zeros(len(order), bool)
    inner = np.flatnonzero(~new)
    for i in range(0, len(inner), ROWS):
        k = inner[i : i + ROWS]
        before, here = text.bytes_at(at[order[k - 1]], limit), text.bytes_at(at[order[k]], limit)
        differ = before != here
        place = differ.argmax(axis=1)
        rows = np.arange(len(k))
        same[k] = ~differ[rows, place]
        wrong[k] = before[rows, place] > here[rows, place]
    for s, n in zip(starts, sizes, strict=True) if wrong.any() else ():
        if wrong[s : s + n].any():
            rows = sorted(order[s : s + n].tolist(), key=lambda j: text.data[at[j] : at[j] + limit].tobytes())
            order[s : s + n] = rows
            cut = [text.data[at[j] : at[j] + limit].tobytes() for j in rows]
            same[s : s + n] = [False, *(x == y for x, y in zip(cut, cut[1:], strict=False))]
    return order, same
