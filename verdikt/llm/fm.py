"""FM-index over a sequence of small numbers: wavelet-tree ranks, backward search, matching statistics, location.

All operations take arrays of queries and work on them side by side.  Symbol 0 separates texts and is never searched.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector per bit of a symbol, levels stored as wholes (no pointers)."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n = len(seq)
        for d in range(self.depth):
            bit = ((seq >> (self.depth - 1 - d)) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            word = np.zeros(n // 64 + 1, np.uint64)
            word.view(np.uint8)[: len(packed)] = packed
            self.words.append(word)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.begin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for d in range(self.depth):
            w = i >> 6
            ones = self.before[d][w] + np.bitwise_count(self.words[d][w] & ((ONE << (i & 63).astype(np.uint64)) - ONE))
            i = np.where((c >> (self.depth - 1 - d)) & 1, self.zeros[d] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c among the first i."""
        return self._down(c, i) - self.begin[c]

    def at(self, i: np.ndarray) -> np.ndarray:
        """Symbol at position i."""
        c = np.zeros(len(i), np.int64)
        for d in range(self.depth):
            w, o = i >> 6, (i & 63).astype(np.uint64)
            bit = ((self.words[d][w] >> o) & ONE).astype(np.int64)
            ones = self.before[d][w] + np.bitwise_count(self.words[d][w] & ((ONE << o) - ONE))
            i = np.where(bit, self.zeros[d] + ones, i - ones)
            c = c * 2 + bit
        return c


def suffix_array(seq: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes in order by prefix doubling, up to ``depth`` symbols; separators differ, the earlier being smaller."""
    n = len(seq)
    apart = seq == 0
    gaps = int(apart.sum())
    rank = np.where(apart, np.cumsum(apart) - 1, seq.astype(np.int64) + gaps)
    k, order = 1, np.argsort(rank, kind="stable")
    top = int(rank.max()) + 1 if n else 0
    while k < (depth or n) and n:
        key = (rank + 1) * (top + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = step
        top = int(step[-1]) + 1
        if top == n:
            break
        k *= 2
    return order


class FMIndex:
    """Index of a sequence that ends with a separator.  ``depth``: longest pattern, if suffixes are ordered up to there only."""

    def __init__(self, seq: np.ndarray, symbols: int, depth: int | None = None, sample: int = 0):
        self.n = len(seq)
        self.sa = suffix_array(seq, depth)
        self.tree = WaveletTree(seq[self.sa - 1].astype(np.int64), symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        if sample:
            # sampled positions: every sample-th one and all that follow a separator, so that no walk crosses one
            keep = (self.sa % sample == 0) | (seq[self.sa - 1] == 0)
            self.marks = WaveletTree(keep.astype(np.int64), 2)
            self.samples = self.sa[keep]
            del self.sa

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with symbol c put before them."""
        return self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns of one length, one pattern a row."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            a, b = self.extend(lo[live], hi[live], patterns[live, k])
            lo[live], hi[live] = a, b
            live = live[b > a]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows of the index, by walking back to a sampled one."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            known = self.marks.at(r) == 1
            done = live[known]
            out[done] = self.samples[self.marks.rank(np.ones(len(done), np.int64), r[known])] + steps[done]
            live, r = live[~known], r[~known]
            c = self.tree.at(r)
            rows[live] = self.first[c] + self.tree.rank(c, r)
            steps[live] += 1
        return out
