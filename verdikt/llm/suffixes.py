"""Suffixes of a text in sorted order, one bucket at a time, with a difference cover for long ties.

Positions whose remainder by PERIOD is in COVER are the sample: of any two positions, some equal shift below PERIOD takes both into it.
The sample is ranked once, by doubling.  All other suffixes are never held in order together: splitters cut them into buckets, a bucket
is sorted by its first PERIOD bytes, and suffixes that agree there are merged by the ranks of the sample at their common shift, however
long they agree.  Besides the text, its words and the ranks, only one bucket is in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# A perfect difference set, every remainder but 0 is the difference of one pair.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
#: Suffixes sorted at once, about.
BLOCK = 1 << 17


def shifts() -> np.ndarray:
    """For each pair of remainders the least shift that takes both into the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    both = np.array([[inside[a : a + PERIOD] & inside[b : b + PERIOD] for b in range(PERIOD)] for a in range(PERIOD)])
    return both.argmax(2).astype(np.int64)


SHIFT = shifts()


def first_of(new: np.ndarray) -> np.ndarray:
    """Index of the first member of each one's group, where ``new`` marks first members."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class Suffixes:
    def __init__(self, data: np.ndarray):
        """``data``: the bytes of the text."""
        self.n = len(data)
        word = np.zeros(self.n + 4 * PERIOD, np.uint64)
        word[: self.n] = data
        for bits in (8, 16, 32):
            rest = word[bits // 8 :].copy()
            word <<= np.uint64(bits)
            word[: len(rest)] |= rest
        self.word = word  # eight bytes from each place on, the first in front
        self.rank = self._ranks()

    def keys(self, at: np.ndarray) -> list[np.ndarray]:
        """The first PERIOD bytes from each place on, as numbers."""
        return [self.word[at], self.word[at + 8], self.word[at + 16], self.word[at + 24] >> np.uint64(8)]

    def _ranks(self) -> np.ndarray:
        """Rank of each suffix of the sample at its place; beyond the text shorter remainders come first."""
        rank = np.full(self.n + PERIOD, -1, np.int32)
        at = np.flatnonzero(np.isin(np.arange(self.n) % PERIOD, COVER))
        if not len(at):
            return rank
        keys = self.keys(at)
        order = np.lexsort(keys[::-1])
        at = at[order]
        new = np.ones(len(at), bool)
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
        rank[at] = first_of(new)
        reach = PERIOD
        while True:
            alone = new & np.append(new[1:], True)
            open_ = np.flatnonzero(~alone)
            if not len(open_):
                return rank
            then = at[open_] + reach
            second = np.where(then < self.n, rank[np.minimum(then, self.n)], self.n - 1 - then)
            group = rank[at[open_]]
            order = np.lexsort((second, group))
            at[open_], second, group = at[open_][order], second[order], group[order]
            new[open_[1:]] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
            rank[at[open_]] = first_of(new)[open_]
            reach *= 2

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b, for suffixes whose first PERIOD bytes are equal."""
        shift = SHIFT[a % PERIOD, b % PERIOD]
        return self.rank[a + shift] < self.rank[b + shift]

    def merged(self, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """``at`` with each group of equal beginnings brought into order, by merging runs of doubling length."""
        first = first_of(new)
        size = np.bincount(first, minlength=len(at))[first]
        width = 1
        rows = np.flatnonzero(size > 1)
        while len(rows):
            start, stop = first[rows], first[rows] + size[rows]
            place = rows - start
            low = start + (place // width ^ 1) * width  # the run that this one is merged with
            high = np.minimum(low + width, stop)
            low = np.minimum(low, high)
            base, x = low.copy(), at[rows]
            left = np.flatnonzero(low < high)
            while len(left):
                middle = (low[left] + high[left]) // 2
                less = self.before(at[middle], x[left])
                low[left] = np.where(less, middle + 1, low[left])
                high[left] = np.where(less, high[left], middle)
                left = left[low[left] < high[left]]
            at[start + place // (2 * width) * (2 * width) + place % width + (low - base)] = x
            width *= 2
            rows = rows[size[rows] > width]
        return at

    def blocks(self, starts: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The suffixes at ``starts`` (PERIOD bytes at least before the end) in order, a bucket at a time, and which begin otherwise than the one before."""
        word = self.word[starts]
        buckets = -(-len(starts) // block)
        sample = np.sort(word[:: max(1, len(word) // (64 * buckets))]) if buckets > 1 else word[:0]
        splitters = np.unique(sample[np.arange(1, buckets) * len(sample) // buckets]) if buckets > 1 else sample
        number = np.searchsorted(splitters, word, "right")
        order = np.argsort(number.astype(np.uint16 if len(splitters) < 1 << 16 else np.int64), kind="stable")
        edges = np.searchsorted(number[order], np.arange(len(splitters) + 2))
        for a, b in zip(edges, edges[1:]):
            at = starts[order[a:b]]
            if len(at):
                keys = self.keys(at)
                by = np.lexsort(keys[::-1])
                new = np.ones(len(at), bool)
                new[1:] = np.any([k[by[1:]] != k[by[:-1]] for k in keys], axis=0)
                yield self.merged(at[by], new), new

    def classes(self, at: np.ndarray, new: np.ndarray, length: int) -> np.ndarray:
        """Which suffixes of a sorted block differ in their first ``length`` bytes (8 at least beyond PERIOD) from the one before."""
        if length < PERIOD + 8:
            raise ValueError(f"length is {PERIOD + 8} at least")
        out = new.copy()
        alike = np.flatnonzero(~new)
        for k in [*range(PERIOD, length - 8, 8), length - 8]:
            differ = self.word[at[alike] + k] != self.word[at[alike - 1] + k]
            out[alike[differ]] = True
            alike = alike[~differ]
        return out
