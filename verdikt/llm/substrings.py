"""Repeated passages: words covered by windows of 50 words that also start in a document with a smaller doc_id.

Windows are dealt to shards by content: each window has an anchor, the least hash among its runs of ANCHOR words, and
consecutive windows with one anchor are a segment.  Equal windows have equal anchors, so all that can match a segment is
in the shard of its anchor, and anchors that one document alone has are dropped before any text moves.  Copies of a
segment meet as one entry with their smallest doc_id.  The distinct segments of a shard are put into an FM-index;
segments are streamed backwards through its wavelet tree, which gives matching statistics: the length (up to 50) and the
interval of the longest match at every word.  Matches of full length report the smallest document of their interval.
An anchor with more than HOT_ENTRIES distinct segments is not put into one shard: the windows of its segments are dealt by
their own hash, the smallest document of each is an aggregation, and windows that very many segments have are joined apart.

Words are compared by bytes within a shard; anchors and whole segments by 64-bit hashes, windows of hot anchors by 128 bits.

Defined results: null and empty texts have no words; rows without doc_id keep all their words and remove none elsewhere;
repeated rows have one id, which is not smaller than itself, so they keep what no smaller id has; a passage repeated in
its own document stays; an empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import landed
from .fm import FMIndex
from .text import Words, is_word_byte, mix, powers, slices

LENGTH = 50
ANCHOR = 8
#: Most windows of one segment.
RUN = 64
#: Words in one index.
SHARD_WORDS = 1 << 20
#: Most distinct segments of an anchor that go to one task (fewer words than one index), and rows of one window in a join.
HOT_ENTRIES = 4096


def segments(texts: pa.Array, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, anchor hash, segment hash) of each segment, and the number of words of each text."""
    w = Words(texts, is_word_byte())
    n = len(w.start)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, w.count
    h = w.hashes()
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:-1], out=total[1:])
    least = mix((total[anchor:] - total[:-anchor]) * inverse[: n - anchor + 1])
    # sliding minimum over the anchors of a window, by doubling
    width, want = 1, length - anchor + 1
    while 2 * width <= want:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    inside = w.text[: n - length + 1] == w.text[length - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (w.text[1 : len(least)] != w.text[: len(least) - 1])
    at = np.arange(len(least))
    begin = np.maximum.accumulate(np.where(new, at, 0))
    first = np.flatnonzero(inside & ((at - begin) % RUN == 0))
    # windows that cross into the next text come last in a text, so a segment ends before them
    last_in_text = w.bounds[1:][w.text[first]] - length + 1
    end = np.minimum(np.concatenate([np.flatnonzero((at - begin) % RUN == 0)[1:], [len(least)]])[np.searchsorted(np.flatnonzero((at - begin) % RUN == 0), first)], last_in_text)
    windows = end - first
    stop = end + length - 1
    seg = mix((total[stop] - total[first]) * inverse[first] + windows.astype(np.uint64))
    text = w.text[first]
    return text, first - w.bounds[text], windows, least[first].view(np.int64), seg.view(np.int64), w.count


class Matcher:
    """FM-index of word sequences, and matching statistics of others against it."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, symbols: int, length: int = LENGTH):
        """Words are numbers from 1; ``owners``: one number per sequence."""
        self.length = length
        seq = np.concatenate([np.zeros(1, np.int64), *[np.concatenate([s, [0]]) for s in sequences]])
        owner = np.concatenate([[0], np.repeat(np.arange(len(sequences)), [len(s) + 1 for s in sequences])])
        self.index = FMIndex(seq, symbols, depth=length)
        sa, n = self.index.sa, len(seq)
        # common prefixes of neighbours in the index, up to the length asked for; they never pass a separator
        same = np.zeros(n + 1, np.int64)
        live = np.arange(1, n)
        for d in range(length):
            a, b = sa[live - 1] + d, sa[live] + d
            ok = (a < n) & (b < n)
            ok[ok] = (seq[a[ok]] == seq[b[ok]]) & (seq[a[ok]] != 0)
            live = live[ok]
            same[live] += 1
        self.same = same
        at = np.arange(n + 1)
        self.before, self.after = np.zeros(n + 1, np.int64), np.full(n + 1, n, np.int64)
        for v in range(1, length + 1):
            mine = same == v
            if mine.any():
                self.before[mine] = np.maximum.accumulate(np.where(same < v, at, 0))[mine]
                self.after[mine] = np.minimum.accumulate(np.where(same < v, at, n)[::-1])[::-1][mine]
        # the same for one word less than the full length
        short = same < length - 1
        self.left = np.maximum.accumulate(np.where(short, at, 0))
        self.right = np.minimum.accumulate(np.where(short, at, n)[::-1])[::-1]
        # smallest owner of each class of equal full windows
        head = np.flatnonzero(same[:n] < length)
        self.class_of = np.cumsum(same[:n] < length) - 1
        self.least = np.minimum.reduceat(owners[owner[sa]], head)

    def stream(self, queries: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each word of each query: length of the longest match from there on, and the smallest owner of full ones."""
        longest = max(map(len, queries))
        order = np.argsort([-len(q) for q in queries], kind="stable")
        size = np.array([len(queries[i]) for i in order])
        words = np.zeros((longest, len(order)), np.int64)  # right-aligned: last words in the last row
        for k, i in enumerate(order):
            words[longest - size[k] :, k] = queries[i]
        found = np.zeros(words.shape, np.int16)
        owner = np.full(words.shape, np.iinfo(np.int64).max)
        lo, hi, m = np.zeros(len(order), np.int64), np.full(len(order), self.index.n), np.zeros(len(order), np.int64)
        for row in range(longest - 1, -1, -1):
            n = int(np.searchsorted(-size, -(longest - row), "right"))  # queries that reach so far
            full = np.flatnonzero(m[:n] == self.length)
            lo[full], hi[full], m[full] = self.left[lo[full]], self.right[hi[full]], self.length - 1
            live = np.arange(n)
            while len(live):
                a, b = self.index.extend(lo[live], hi[live], words[row, live])
                ok = (b > a) & (words[row, live] > 0)
                done = live[ok]
                lo[done], hi[done], m[done] = a[ok], b[ok], m[done] + 1
                live = live[~ok]
                lost = live[m[live] == 0]
                lo[lost], hi[lost] = 0, self.index.n
                live = live[m[live] > 0]
                # a shorter match: the smallest interval around with a shorter common prefix
                x, y = lo[live], hi[live]
                p = np.maximum(self.same[x], self.same[y])
                lo[live] = np.where(self.same[x] < p, x, self.before[x])
                hi[live] = np.where(self.same[y] < p, y, self.after[y])
                m[live] = p
                root = live[p == 0]
                lo[root], hi[root] = 0, self.index.n
            found[row, :n] = m[:n]
            full = np.flatnonzero(m[:n] == self.length)
            owner[row, full] = self.least[self.class_of[lo[full]]]
        out, who = [np.zeros(0)] * len(order), [np.zeros(0)] * len(order)
        for k, i in enumerate(order):
            out[i], who[i] = found[longest - size[k] :, k], owner[longest - size[k] :, k]
        return out, who


def window_owners(sequences: list[list[bytes]], owners: np.ndarray, length: int = LENGTH, shard_words: int = SHARD_WORDS) -> list[np.ndarray]:
    """Smallest owner of each window of each sequence, among all sequences that have it."""
    ids: dict[bytes, int] = {}
    numbers = [np.array([ids.setdefault(x, len(ids) + 1) for x in s], np.int64) for s in sequences]
    best = [np.full(len(s) - length + 1, np.iinfo(np.int64).max) for s in numbers]
    size = np.cumsum([len(s) + 1 for s in numbers])
    block = (size - 1) // shard_words
    for b in np.unique(block):
        mine = np.flatnonzero(block == b)
        matcher = Matcher([numbers[i] for i in mine], owners[mine], len(ids) + 1, length)
        _, who = matcher.stream(numbers)
        best = [np.minimum(x, y[: len(x)]) for x, y in zip(best, who)]
    return best


SEGMENTS = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(x, T.LongType()) for x in ("anchor", "seg")] + [T.StructField(x, T.IntegerType()) for x in ("sum", "start", "windows")])


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = part.column(1)
            text, first, windows, anchor, seg, _ = segments(texts)
            sums = np.array([checksum(t) for t in texts], np.int64).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text)), pa.array(anchor), pa.array(seg), pa.array(sums[text] if len(text) else np.zeros(0, np.int32)), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32))],
                SEGMENTS.fieldNames(),
            )


def checksum(text: pa.StringScalar) -> int:
    """Tells rows of one doc_id apart."""
    return zlib.crc32(text.as_buffer()) - (1 << 31)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [t.as_buffer() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([zlib.crc32(t) - (1 << 31) for t in raw], pa.int32()), pa.array([zlib.compress(t, 1) for t in raw], pa.binary())], ["doc_id", "sum", "packed"]
        )


def _wanted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the segments that stand for their copies."""
    for batch in batches:
        out = []
        for doc, packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = zlib.decompress(packed.as_buffer()).split()
            out += [(w["anchor"], w["seg"], doc, b" ".join(words[w["start"] : w["start"] + w["windows"] + LENGTH - 1])) for w in wanted]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["anchor", "seg", "doc_id", "words"])


OWNERS = "anchor bigint, seg bigint, owners array<struct<first:int,end:int,owner:bigint>>"
_OWNERS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("owner", pa.int64())]))


def runs(owner: np.ndarray) -> list[dict[str, int]]:
    """Windows first to end - 1 with one owner."""
    cut = np.flatnonzero(np.diff(owner)) + 1
    edge = [0, *cut.tolist(), len(owner)]
    return [{"first": a, "end": b, "owner": int(owner[a])} for a, b in zip(edge, edge[1:])]


def _shard_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: whole groups of anchors are put into one index up to SHARD_WORDS."""
    rows: list[tuple] = []
    size = 0

    def solved() -> pa.RecordBatch:
        best = window_owners([r[3].split(b" ") for r in rows], np.array([r[2] for r in rows], np.int64))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([runs(b) for b in best], _OWNERS)], ["anchor", "seg", "owners"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if size >= SHARD_WORDS and row[0] != rows[-1][0]:
                yield solved()
                rows, size = [], 0
            rows.append(row)
            size += row[3].count(b" ") + 2
    if rows:
        yield solved()


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, packed, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = zlib.decompress(packed.as_buffer()).split()
            n = len(words)
            if spans:
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, [s["first"] for s in spans], 1)
                np.add.at(change, [s["end"] for s in spans], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            out.append((doc, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


WINDOWS = "anchor bigint, seg bigint, at int, window binary, doc_id bigint"


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window of each segment (at most RUN), with a hash of its words."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
    for batch in batches:
        out = []
        for anchor, seg, doc, words in zip(*[c.to_pylist() for c in batch.columns]):
            words = words.split(b" ")
            out += [(anchor, seg, k, hashlib.blake2b(b" ".join(words[k : k + LENGTH]), digest_size=16).digest(), doc) for k in range(len(words) - LENGTH + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["anchor", "seg", "at", "window", "doc_id"])


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a segment with their owners, as runs of one owner."""
    for batch in batches:
        out = []
        for found in batch.column(2).to_pylist():
            spans: list[dict[str, int]] = []
            for at, owner in sorted((x["at"], x["owner"]) for x in found):
                if spans and spans[-1]["end"] == at and spans[-1]["owner"] == owner:
                    spans[-1]["end"] = at + 1
                else:
                    spans.append({"first": at, "end": at + 1, "owner": owner})
            out.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _OWNERS)], ["anchor", "seg", "owners"])


def dealt(found: DataFrame, hot_entries: int) -> tuple[DataFrame, DataFrame | None]:
    """Entries (anchor, seg, windows, rep, many) of anchors that two documents have; those of hot anchors apart, if any."""
    # copies of a segment are one entry, that of the smallest document
    all_entries = found.groupBy("anchor", "seg", "windows").agg(F.min(F.struct("doc_id", "sum", "start")).alias("rep"), F.max("doc_id").alias("last"))
    sizes = found.groupBy("anchor", "seg").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    sizes = sizes.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("n"))
    hot = landed(sizes.filter(F.col("n") > hot_entries).select("anchor", "least", "most"), "substrings-hot-anchors")
    some = not hot.isEmpty()
    cold = all_entries.join(hot, "anchor", "left_anti") if some else all_entries
    group = Window.partitionBy("anchor")
    cold = cold.withColumns({"least": F.min("rep.doc_id").over(group), "most": F.max("last").over(group), "entries": F.count("*").over(group)})
    cold = cold.filter("least < most").select("anchor", "seg", "windows", "rep", (F.col("entries") > 1).alias("many"))
    return cold, all_entries.join(hot.filter("least < most"), "anchor", "left_semi").select("anchor", "seg", "windows", "rep", F.lit(True).alias("many")) if some else None


def hot_owners(words: DataFrame, hot_rows: int) -> DataFrame:
    """Owners of the windows of hot anchors' segments that several segments of different documents have."""
    rows = landed(words.mapInArrow(_window_rows, WINDOWS), "substrings-windows")
    shared = rows.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    shared = landed(shared.filter("owner < most").select("window", "owner", "n"), "substrings-shared")
    common = landed(shared.filter(F.col("n") > hot_rows).select("window", "owner"), "substrings-common")
    rest = rows.join(common, "window", "left_anti").join(shared.filter(F.col("n") <= hot_rows), "window").select("anchor", "seg", "at", "owner")
    hits = rows.join(common, "window").select("anchor", "seg", "at", "owner").unionByName(rest)
    return hits.groupBy("anchor", "seg").agg(F.collect_set(F.struct("at", "owner")).alias("found")).mapInArrow(_joined_runs, OWNERS)


def removal_spans(docs: DataFrame, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """(doc_id, sum, spans): ranges of words that a smaller document has, for the rows that have any.

    ``docs``: doc_id (long) and text without nulls; ``sum`` tells rows of one id apart.
    """
    found = landed(docs.filter(F.col("doc_id").isNotNull()).mapInArrow(_segment_rows, SEGMENTS), "substrings-segments")
    packed = docs.mapInArrow(_compressed, "doc_id bigint, sum int, packed binary")

    def words_of(entries: DataFrame) -> DataFrame:
        wanted = entries.groupBy("rep.doc_id", "rep.sum").agg(F.collect_list(F.struct("rep.start", "windows", "anchor", "seg")).alias("wanted"))
        return packed.join(wanted, ["doc_id", "sum"]).select("doc_id", "packed", "wanted").mapInArrow(_wanted_words, "anchor bigint, seg bigint, doc_id bigint, words binary")

    cold, hot = dealt(found, hot_entries)
    entries = landed(cold, "substrings-entries")
    # rows that are alike give a segment twice
    sharded = words_of(entries.filter("many")).repartition("anchor").sortWithinPartitions("anchor", "seg").mapInArrow(_shard_owners, OWNERS)
    own = F.array(F.struct(F.lit(0).alias("first"), F.col("windows").alias("end"), F.col("rep.doc_id").alias("owner"))).alias("owners")
    alone = entries.filter("not many").select("anchor", "seg", own)
    owners = landed(sharded.dropDuplicates(["anchor", "seg"]).unionByName(alone), "substrings-owners")
    if hot is not None:
        # copies of a hot segment have its smallest document, whatever its windows have
        owners = owners.unionByName(hot.select("anchor", "seg", own)).unionByName(landed(hot_owners(words_of(hot), hot_entries), "substrings-hot-owners"))

    spans = found.join(owners, ["anchor", "seg"]).select("doc_id", "sum", "start", F.inline("owners")).filter("owner < doc_id")
    span = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end") + (LENGTH - 1)).alias("end"))
    return spans.groupBy("doc_id", "sum").agg(F.collect_list(span).alias("spans"))


def without_repeats(docs: DataFrame, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    packed = d.mapInArrow(_compressed, "doc_id bigint, sum int, packed binary")
    return packed.join(removal_spans(d, hot_entries), ["doc_id", "sum"], "left").select("doc_id", "packed", "spans").mapInArrow(_kept, RESULT)
