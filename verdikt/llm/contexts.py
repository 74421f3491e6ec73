"""The context tree: numbers of (context, byte), weights of its nodes and log-probabilities of bytes.

A symbol is a byte after ``depth`` others, as one number: the nearest context byte first, the byte itself last.  In
sorted symbols the nodes of a depth, and of a bit of the byte, are then runs of neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from .text import buffers, lower_byte, mix

#: Depth from which a subtree lies in one bucket; the nodes above it are at most 65,535.
TOP = 2
#: Weighted log-probabilities of depth TOP are added up as whole numbers of this part, in any order.
UNIT = 1e-6


def symbols(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of every byte and end of the texts, and the place of the first one of each text."""
    off, data = buffers(texts)
    base = off[0]
    size = np.diff(off) + depth + 1  # zero bytes, the text, one zero byte
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    text = lower_byte()[data[base : off[-1]]]
    out[np.arange(len(text)) + np.repeat(at[:-1] + depth - (off[:-1] - base), np.diff(off))] = text
    n = max(0, len(out) - depth)
    key = np.zeros(n, np.int64)
    for back in range(1, depth + 1):
        key |= out[depth - back : depth - back + n]
        key <<= 8
    key |= out[depth : depth + n]
    own = np.ones(n, bool)
    own[(at[1:-1, None] - np.arange(1, depth + 1)).ravel()] = False  # those that would cross into the next text
    return key[own], at[:-1] - depth * np.arange(len(texts))


def added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct symbols of several lists, and the sum of each one's numbers."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = _starts(key)
    return key[start], np.add.reduceat(n[order], start) if len(start) else n


def distinct(found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct symbols, the place of each symbol's own among them, and the first symbols of the texts."""
    coded = pa.array(found[0]).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy(), found[1]


def bucket_of(key: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Bucket of each symbol; symbols with the same TOP nearest bytes share one."""
    return (mix((key >> (8 * (depth + 1 - TOP))).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _starts(ids: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for positive numbers: Stirling's series eight steps up."""
    low = np.zeros(len(x))
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


_SMALL = np.arange(1 << 12)
_HALF, _WHOLE = _log_gamma(_SMALL + 0.5), _log_gamma(_SMALL + 1.0)


def _own(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log-probability that Krichevsky and Trofimov's estimate gives to counts of zeros and ones."""

    def gamma(n: np.ndarray, small: np.ndarray, add: float) -> np.ndarray:
        out = small[np.minimum(n, len(small) - 1)]
        large = np.flatnonzero(n >= len(small))
        out[large] = _log_gamma(n[large] + add)
        return out

    return gamma(zero, _HALF, 0.5) + gamma(one, _HALF, 0.5) - gamma(zero + one, _WHOLE, 1.0) - math.log(math.pi)


def _weighted(own: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's log-probability, the mean of its own estimate and of its longer contexts; the share that its own has."""
    both = np.logaddexp(own, longer) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


class _Nodes:
    """Nodes of one depth for one bit of the byte: runs of symbols."""

    def __init__(self, key: np.ndarray, n: np.ndarray, bit: int):
        ids = key >> (8 - bit)
        self.start = _starts(ids)
        self.of = np.zeros(len(key), np.int32)
        self.of[self.start[1:]] = 1
        np.cumsum(self.of, out=self.of)
        total, self.one = (np.add.reduceat(x, self.start) if len(key) else n for x in (n, n * (key >> (7 - bit) & 1)))
        self.zero = total - self.one
        self.ids = ids[self.start]
        self.chance = (self.one + 0.5) / (total + 1)  # of a one, by the node's own counts


class Subtree:
    """The tree from depth TOP down over sorted distinct symbols; a symbol may have count 0, its new nodes give one half."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int):
        #: per depth, the deepest first: symbols, counts; and the place of each symbol among those of one byte less
        self.levels, self.up = [(key, n)], []
        for _ in range(depth, TOP, -1):
            key, n = self.levels[-1]
            short = (key >> 16 << 8) | (key & 255)
            order = np.argsort(short, kind="stable")
            start = _starts(short[order])
            up = np.zeros(len(key), np.int32)
            up[start[1:]] = 1
            place = np.empty(len(key), np.int32)
            place[order] = np.cumsum(up)
            self.up.append(place)
            self.levels.append((short[order[start]], np.add.reduceat(n[order], start) if len(key) else n))

    def _upward(self, bit: int) -> tuple[list[_Nodes], list[np.ndarray | None], np.ndarray]:
        """Nodes per depth, the share that each one's own estimate has, and weighted log-probabilities of depth TOP."""
        nodes, shares, weighted = [], [], None
        for d, (key, n) in enumerate(self.levels):
            here = _Nodes(key, n, bit)
            own = _own(here.zero, here.one)
            if weighted is None:
                weighted, share = own, None
            else:
                parent = here.of[self.up[d - 1][nodes[-1].start]]
                weighted, share = _weighted(own, np.bincount(parent, weighted, len(own)))
            nodes.append(here)
            shares.append(share)
        return nodes, shares, weighted

    def top_nodes(self) -> np.ndarray:
        """Of each node of depth TOP: its parent (last byte, 1 and the bits so far), weighted log-probability, zeros, ones."""
        out = []
        for bit in range(8):
            nodes, _, weighted = self._upward(bit)
            last, bits = nodes[-1].ids >> (8 * TOP - 8 + bit), nodes[-1].ids & ((1 << bit) - 1)
            out.append(np.stack([last << 8 | 1 << bit | bits, np.rint(weighted / UNIT).astype(np.int64), nodes[-1].zero, nodes[-1].one]))
        return np.concatenate(out, axis=1)

    def logs(self, above: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Log10 probability of each symbol; ``above`` comes from ``upper``."""
        key = self.levels[0][0]
        out = np.zeros(len(key))
        for bit in range(8):
            nodes, shares, _ = self._upward(bit)
            ids = nodes[-1].ids
            node = (ids >> (8 * TOP - 8 + bit)) << 8 | 1 << bit | ids & ((1 << bit) - 1)
            told, rest = above[0][node], above[1][node]
            for d in range(len(nodes) - 1, -1, -1):
                if d < len(nodes) - 1:
                    parent = nodes[d + 1].of[self.up[d][nodes[d].start]]
                    told, rest = told[parent], rest[parent]
                part = rest if shares[d] is None else rest * shares[d]
                told, rest = told + part * nodes[d].chance, rest - part
            q = told[nodes[0].of]
            out += np.log10(np.where(key >> (7 - bit) & 1, q, 1 - q))
        return out


def upper(node: np.ndarray, weighted: np.ndarray, zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What depths 0 and 1 give to the chance of a one at each of 65,536 nodes of depth 1, and the share left for longer contexts.

    Takes the sums over ``top_nodes`` by parent.
    """
    counts, longer = np.zeros((2, 1 << 16), np.int64), np.zeros(1 << 16)
    counts[0, node], counts[1, node], longer[node] = zero, one, weighted * UNIT
    both, share = _weighted(_own(*counts), longer)
    root = counts.reshape(2, 256, 256).sum(1)
    _, root_share = _weighted(_own(*root), both.reshape(256, 256).sum(0))
    chance = lambda c: (c[1] + 0.5) / (c[0] + c[1] + 1)
    s, p = np.tile(root_share, 256), np.tile(chance(root), 256)
    return s * p + (1 - s) * share * chance(counts), (1 - s) * (1 - share)


def summed(nodes: np.ndarray) -> np.ndarray:
    """Sums over ``top_nodes`` by parent."""
    order = np.argsort(nodes[0], kind="stable")
    start = _starts(nodes[0][order])
    if not len(start):
        return nodes
    return np.stack([nodes[0][order][start], *(np.add.reduceat(x[order], start) for x in nodes[1:])])
