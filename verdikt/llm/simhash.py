"""Near copies by SimHash: fingerprints, and the classes that links of at most two differing bits make.

Links are found by a self-join of the binary trie of the distinct fingerprints.  Node pairs are traversed together from
the top; a pair carries the number of bits its two sides differ in and is dropped beyond the budget.  The trie is joined
three times, rotated so that another third of the bits leads: two fingerprints within the budget agree on one whole
third, so that each join starts at the node pairs (n, n) below the leading third, and those nodes are dealt to tasks.
A node with too many fingerprints is dealt by its next bits to node pairs that can still be within the budget.

Copies share a fingerprint and meet once.  A task returns a spanning forest of the links it finds, never all pairs;
forests are merged by label propagation with pointer jumping on tables in the shared folder.

Defined results: null and empty texts have the fingerprint zero and are linked like any other; rows without doc_id
belong to classes but never name one (a class of such rows alone has a null name); repeated rows are one class; an
empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import landed
from .text import buffers, map_texts

BUDGET = 2
#: Lowest bits of the three thirds; the first has 22 bits, of which 21 are used to start.
THIRDS = (42, 21, 0)
START = 21
#: Rotations to the left that bring each third to the top.
TURNS = tuple((64 - (low + START)) % 64 if low < 42 else 0 for low in THIRDS)
#: Distinct fingerprints below one starting node beyond which its next bits deal them out, and the number of those bits.
NODE_ROWS = 1 << 20
DEAL_BITS = 8
#: Node pairs that are traversed at once.
FRONTIER = 1 << 19


def text_fingerprints(texts: pa.Array) -> np.ndarray:
    """SimHash of each text, as unsigned 64-bit numbers."""
    off, data = buffers(texts)
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(len(texts)):
        words = data[off[i] : off[i + 1]].tobytes().lower().split()  # ASCII letters and the six blanks only
        if not words:
            continue
        joined = b" ".join(words)
        end = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        start = [0, *[e + 1 for e in end[:-1]]]
        before = len(hashes)
        hashes += [digest(joined[a:b], 42) for a, b in zip(start, end[2:])] or [digest(joined, 42)]
        sizes[i] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero(sizes)
        first = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        over = (2 * ones > sizes[some, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a (signed) long."""
    fields = T.StructType([T.StructField("fp", T.LongType())])
    return map_texts(docs, lambda x: [pa.array(text_fingerprints(x).view(np.int64))], fields, keep)


def rotated(v: np.ndarray, left: int) -> np.ndarray:
    left %= 64
    return v if not left else (v << np.uint64(left)) | (v >> np.uint64(64 - left))


class Forest:
    """Sets of row numbers, merged as links are found."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up
            a, b = self.parent[a], self.parent[b]
            far = a != b
            a, b = np.maximum(a[far], b[far]), np.minimum(a[far], b[far])
            np.minimum.at(self.parent, a, b)

    def roots(self) -> np.ndarray:
        self.add(np.zeros(1, np.int64), np.zeros(1, np.int64))
        return self.parent


def linked(values: np.ndarray, node: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Root row of each row: rows of one starting ``node`` within the budget are linked.

    ``values`` are rotated fingerprints; rows are sorted by (node, value), values are distinct in a node, and the first
    START bits of a node's values are equal.
    """
    n = len(values)
    forest = Forest(n)
    edge = np.flatnonzero(np.diff(node)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    # ones[d][i]: rows before i whose bit d is set; a node's rows with the bit set are its last ones
    ones: dict[int, np.ndarray] = {}

    def middle(lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        if d not in ones:
            bit = (values >> np.uint64(63 - d)) & np.uint64(1)
            ones[d] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return hi - (ones[d][hi] - ones[d][lo])

    stack = [(START, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            for k in range(0, len(al), FRONTIER):
                s = slice(k, k + FRONTIER)
                stack.append((d, al[s], ah[s], bl[s], bh[s], err[s]))
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            a, b = al[single], bl[single]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            forest.add(a[near], b[near])
            al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        if d == 64:  # several rows of one value, which do not occur
            near = np.bitwise_count(values[al] ^ values[bl]) <= budget
            forest.add(al[near], bl[near])
            continue
        am, bm = middle(al, ah, d), middle(bl, bh, d)
        own = al == bl
        sides = [(al, am, bl, bm, err, True), (am, ah, bm, bh, err, True), (al, am, bm, bh, err + 1, True), (am, ah, bl, bm, err + 1, ~own)]
        parts = []
        for a0, a1, b0, b1, e, use in sides:
            live = (a1 > a0) & (b1 > b0) & (e <= budget) & use & ((a0 != b0) | (a1 - a0 > 1))
            parts.append(tuple(x[live] for x in (a0, a1, b0, b1, e)))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))
    return forest.roots()


def _join_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest of the links below the starting nodes of one partition (numbers only, eight bytes a fingerprint)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    turn, node, fp = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(3))
    for k, left in enumerate(TURNS):
        pick = turn == k
        values, where = rotated(fp[pick].view(np.uint64), left), node[pick]
        order = np.lexsort((values, where))
        values, where = values[order], where[order]
        if not len(values):
            continue
        root = linked(values, where)
        child = np.flatnonzero(root != np.arange(len(root)))
        back = lambda rows: rotated(values[rows], 64 - left).view(np.int64)  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(back(child)), pa.array(back(root[child]))], ["a", "b"])


def links(nodes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """A spanning forest (a, b) of the links between the distinct fingerprints ``nodes.fp``."""
    lead = [F.shiftrightunsigned("fp", 42), F.shiftrightunsigned("fp", 21).bitwiseAND((1 << 21) - 1), F.col("fp").bitwiseAND((1 << 21) - 1)]
    deal = [F.shiftrightunsigned("fp", 42 - DEAL_BITS), F.shiftrightunsigned("fp", 21 - DEAL_BITS), F.shiftrightunsigned("fp", 64 - DEAL_BITS)]
    mask = (1 << DEAL_BITS) - 1
    turns = F.array(*[F.struct(F.lit(k).alias("turn"), x.alias("lead"), y.bitwiseAND(mask).alias("own")) for k, (x, y) in enumerate(zip(lead, deal))])
    rows = nodes.select("fp", F.inline(turns))
    full = rows.groupBy("turn", "lead").agg(F.count("*").alias("n")).filter(F.col("n") > node_rows).select("turn", "lead", F.lit(True).alias("full"))
    near = F.filter(F.sequence(F.lit(0), F.lit(mask)), lambda s: (s == F.col("own")) | ((s < F.col("own")) & (F.bit_count(s.cast("bigint").bitwiseXOR(F.col("own"))) <= BUDGET)))
    rows = rows.join(full, ["turn", "lead"], "left").select(
        "turn", F.explode(F.when(F.col("full"), near).otherwise(F.array(F.lit(0)))).alias("part"), "lead", "fp"
    )
    node = (F.col("lead") * (1 << DEAL_BITS) + F.col("part")).cast("bigint")
    rows = rows.select("turn", node.alias("node"), "fp").repartition("turn", "node")
    return rows.mapInArrow(_join_nodes, "a bigint, b bigint")


def labels(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(fp, label): the smallest member of each class, for the members of ``edges``."""
    edges = landed(edges, name + "-edges")
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    now = landed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "fp"), name)
    while True:
        seen = both.join(now, both["v"] == now["fp"]).groupBy("u").agg(F.min("label").alias("seen"))
        step = now.join(seen, now["fp"] == seen["u"], "left").select("fp", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = now.select(F.col("fp").alias("at"), F.col("label").alias("up"))
        step = step.join(up, F.col("label") == F.col("at"), "left").select("fp", "old", F.least("label", "up").alias("label"))
        step = landed(step, name)
        now = step.select("fp", "label")
        if step.filter("label <> old").isEmpty():
            return now


def classes(fps: DataFrame) -> DataFrame:
    """(fp, label, component_id) of all fingerprints of ``fps`` (doc_id, fp)."""
    nodes = landed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    found = labels(links(nodes), "simhash-labels")
    named = nodes.join(found, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    names = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return named.join(names, "label").select("fp", "label", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document."""
    fps = landed(fingerprints(docs, ["doc_id"]), "simhash")
    return fps.join(classes(fps), "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest doc_id, unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("number"))
    rows = landed(fingerprints(rows, ["row", "doc_id", "number"]), "simhash-rows")
    fps = rows.select("doc_id", "fp", "number")
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("number"))).alias("best")
    stay = fps.join(classes(fps), "fp").groupBy("label").agg(best).select(F.col("best.number").alias("number"))
    return rows.select("row", "number").join(stay, "number", "left_semi").select("row.*")
