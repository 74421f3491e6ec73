"""Benchmark decontamination: windows of benchmark words that occur in documents, found in FM-indexes of the documents.

Each task cuts its documents into shards of a few megabytes and indexes the words of a shard.  A word that no benchmark
item has cannot be part of an occurrence; it separates, and runs shorter than the shortest window are left out, so an
index holds only what can match.  The windows of all items are searched backwards through wavelet-tree ranks, found rows
are located by sampled suffix positions, each occurrence is compared word by word, and spans are merged.

The benchmark is read in blocks of at most BLOCK_WORDS window words.  A block is broadcast to the tasks, so that what is
broadcast is bounded.  With several blocks the documents are numbered and written once, and that table is read once for each
block; what comes back from a block are spans and items only.

Defined results: null and empty texts have no words and no hits; a null or empty item matches nothing; items that share
an item_id count once, and one without item_id is listed as an empty name; repeated rows are judged one by one; with an
empty benchmark nothing is hit; other columns are carried along untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import landed
from .fm import FMIndex
from .text import Words, is_alnum_byte, lower_byte, map_texts

WINDOW = 13
#: Words of benchmark windows in one block: 13 times the words of its items.
BLOCK_WORDS = 4_000_000
SAMPLE = 8

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("_starts", T.ArrayType(T.LongType())),
        T.StructField("_ends", T.ArrayType(T.LongType())),
        T.StructField("_items", T.ArrayType(T.StringType())),
    ]
)


class Phrases:
    """The distinct windows of some items: words as numbers from 1, and the items that have each window."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            w = Words(pa.array([text.decode()]), is_alnum_byte(), lower_byte()).strings(0)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                owners[tuple(w[k : k + window])].add(item)
        vocabulary = sorted({x for p in owners for x in p})
        ids = {x: k + 1 for k, x in enumerate(vocabulary)}
        self.words = [b"", *vocabulary]
        self.symbols = len(vocabulary) + 1
        joined = Words(pa.array([b" ".join(vocabulary).decode()]), is_alnum_byte())
        h = joined.hashes() if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hash, self.id = h[order], (order + 1).astype(np.int64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.shortest = min(map(len, owners), default=0)
        by_size = defaultdict(list)
        for p in owners:
            by_size[len(p)].append(p)
        self.groups = [(np.array([[ids[x] for x in p] for p in ps], np.int64), [sorted(owners[p]) for p in ps]) for _, ps in sorted(by_size.items())]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.hash, hashes[maybe])
        at[at == len(self.hash)] = 0
        same = self.hash[at] == hashes[maybe]
        out[maybe[same]] = self.id[at[same]]
        return out


def occurrences(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[tuple[int, int, int, list[str]]]]:
    """Words of each text, and (text, first word, end word, items) of each occurrence of a window."""
    w = Words(texts, is_alnum_byte(), lower_byte())
    if not phrases.groups or not len(w.start):
        return w.count, []
    ids = phrases.numbers(w.hashes())
    inside = ids > 0
    edge = np.zeros(len(ids) + 1, bool)
    edge[w.bounds] = True
    opens = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    closes = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long = closes - opens >= phrases.shortest
    opens, closes = opens[long], closes[long]
    if not len(opens):
        return w.count, []
    # the sequence: a separator, then each run with a separator behind it; place: word number of each symbol
    size = closes - opens + 1
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) + 1
    place = np.arange(1 + size.sum()) - np.concatenate([[0], np.repeat(start - opens, size)])
    seq = np.zeros(len(place), np.int64)
    live = np.ones(len(place), bool)
    live[0] = False
    live[start + size - 1] = False
    seq[live] = ids[place[live]]
    index = FMIndex(seq, phrases.symbols, sample=SAMPLE)
    found = []
    for patterns, owners in phrases.groups:
        lo, hi = index.search(patterns)
        hit = np.flatnonzero(hi > lo)
        times = (hi - lo)[hit]
        which = np.repeat(hit, times)
        rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[hit], times)
        first = place[index.locate(rows)]
        m = patterns.shape[1]
        for p, a in zip(which.tolist(), first.tolist()):
            if all(w.data[w.start[a + k] : w.end[a + k]].tobytes() == phrases.words[patterns[p, k]] for k in range(m)):
                t = int(w.text[a])
                found.append((t, a - int(w.bounds[t]), a - int(w.bounds[t]) + m, owners[p]))
    return w.count, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _columns(texts: pa.Array, phrases: Phrases) -> list[pa.Array]:
    count, found = occurrences(texts, phrases)
    spans, items = [[] for _ in count], [set() for _ in count]
    for t, a, b, names in found:
        spans[t].append((a, b))
        items[t].update(names)
    spans = [merged(s) for s in spans]
    many = pa.list_(pa.int64())
    return [
        pa.array(count, pa.int64()),
        pa.array([[a for a, _ in s] for s in spans], many),
        pa.array([[b for _, b in s] for s in spans], many),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
    ]


def blocks(benchmark: DataFrame, block_words: int, window: int):
    """The items in blocks of bounded size, each (item_id as text, text)."""
    sized = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("words", window * (1 + F.octet_length("text") / 2))
    # items are dealt to blocks by hash; an item is the least that a block holds
    count = int((sized.agg(F.sum("words")).first()[0] or 0) // block_words) + 1
    for k in range(count):
        part = sized if count == 1 else sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(r.item, r.text.encode()) for r in part.select("item", "text").toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str], window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Columns ``keep`` and: n_words, spans (merged ranges of words, end exclusive), n_hit, items, contaminated.

    A document is contaminated if at least a twentieth of its words are hit.
    """
    context = docs.sparkSession.sparkContext
    row = F.struct(*[F.col(f"`{k}`") for k in keep]).alias("_row")
    d = docs.select(row, F.col("text").cast("string").alias("text"))
    done: list[DataFrame] = []
    if block_words and (parts := blocks(benchmark, block_words, window)):
        parts = iter(parts)
        items = next(parts)
        while items is not None:
            after = next(parts, None)
            shared = context.broadcast(Phrases(items, window))
            if not done and after is not None:
                d = landed(d.withColumn("_number", F.monotonically_increasing_id()), "decontamination")
            if "_number" in d.columns:
                done.append(map_texts(d, lambda x, s=shared: _columns(x, s.value), FIELDS, ["_number"]))
            else:
                out = map_texts(d, lambda x, s=shared: _columns(x, s.value), FIELDS, ["_row"])
            items = after
    if done:
        out = _merge_blocks(d, done)
    spans = F.arrays_zip(F.col("_starts").alias("start"), F.col("_ends").alias("end"))
    out = out.select("_row.*", "n_words", spans.alias("spans"), F.aggregate(F.zip_with("_ends", "_starts", lambda b, a: b - a), F.lit(0).cast("bigint"), lambda n, x: n + x).alias("n_hit"), F.col("_items").alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _merge_blocks(d: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Results of several blocks put together: spans that touch become one, items are joined."""
    rows = done[0]
    for x in done[1:]:
        rows = rows.union(x)
    rows = landed(rows, "decontamination-blocks")
    words = rows.groupBy("_number").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    w = Window.partitionBy("_number").orderBy("a", "b")
    spans = rows.select("_number", F.inline(F.arrays_zip(F.col("_starts").alias("a"), F.col("_ends").alias("b"))))
    spans = spans.withColumn("top", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("a") <= F.col("top"), 0).otherwise(1)).over(w))
    spans = spans.groupBy("_number", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = spans.groupBy("_number").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("s"))
    none = F.array().cast("array<bigint>")
    out = d.select("_number", "_row").join(words, "_number").join(spans, "_number", "left")
    return out.select("_row", "n_words", F.coalesce("s.a", none).alias("_starts"), F.coalesce("s.b", none).alias("_ends"), "_items")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return contamination(docs.select(row.alias("row"), "text"), benchmark, ["row"]).filter(~F.col("contaminated")).select("row.*")
