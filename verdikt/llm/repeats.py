"""Repeated byte strings: bytes covered by strings of 100 bytes that also start earlier, found in sorted suffixes.

All strings of LENGTH bytes (windows) of all documents are told apart.  A window's anchor is the least hash among its runs of SEED bytes, and
consecutive windows of one anchor are a segment.  Equal windows have equal anchors, so what can match a segment is where its anchor is:
segments are dealt by anchor as a few numbers each, those whose anchor occurs once are dropped, copies of a segment leave one entry (that
which starts first; the others are repeats altogether), and only the texts of entries move.  The entries that share a task are one text,
whose suffixes are sorted block by block with a difference cover (``suffixes``); neighbours that agree in 100 bytes are a class, and all of
a class but the windows that start first are repeats.

Runs of SEED bytes that make up more than HOT_SHARE of all are never anchors of windows that have another run, so a passage that very many
documents share gathers its own few distinct windows, and not those of every surrounding.  They are counted on every INSPECTED-th slice of
each task's texts; that choice deals the work and does not change the result.  Long texts are cut into pieces that overlap.

Windows are compared by bytes; copies of whole segments are known by 64 bits of content hash besides the 64 bits of their anchor.

Defined results: null and empty texts have no bytes, and texts below 100 bytes keep all; rows without doc_id count as one document after all
others; rows that share a doc_id start at the same place, so none of them is earlier than another, and a window is a repeat if it also
starts at an earlier place of that doc_id; repeated rows therefore stay as their first does; an empty table gives an empty result; other
columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import landed
from .suffixes import Suffixes, first_of
from .text import BASE, BYTE_VALUE, buffers, mix, slices

LENGTH = 100
SEED = 32
#: Most windows of one segment.
RUN = 128
#: Bytes of a text worked on at once.
PIECE = 1 << 20
HOT_SHARE = 1 / 65536
INSPECTED = 4
#: Bytes of texts whose segments one task gets, on average, and bytes of entries sorted together.
TASK_BYTES = 16 << 20
SORTED_BYTES = 2 << 20

CODEC = "zstd"
NO_ID = (1 << 63) - 1


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED (a power of two) bytes from each place on."""
    h, base, width = BYTE_VALUE[data], BASE, 1
    while width < SEED:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), 2 * width
    return mix(h)


def least_of(h: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each place on."""
    width = 1
    while 2 * width <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (n - width)], h[n - width :]) if width < n else h


class Hot:
    """Hashes that are too frequent for anchors."""

    def __init__(self, values: list[int]):
        self.values = np.sort(np.array(values, np.int64).view(np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.values & np.uint64((1 << 20) - 1)] = True

    def demoted(self, h: np.ndarray) -> np.ndarray:
        """Hashes in an order with the frequent ones last."""
        out = h >> np.uint64(1)
        at = np.flatnonzero(self.maybe[h & np.uint64((1 << 20) - 1)]) if len(self.values) else np.zeros(0, np.int64)
        if len(at):
            k = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
            out[at[self.values[k] == h[at]]] |= np.uint64(1 << 63)
        return out


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of many texts or of a piece of a long one: bytes, their offsets, the rows, and where in its text each begins."""
    offsets, data = buffers(batch.column(batch.num_columns - 1))
    if batch.num_rows == 1 and offsets[1] - offsets[0] > PIECE + LENGTH:
        for at in range(offsets[0], offsets[1] - LENGTH + 1, PIECE):
            to = min(at + PIECE + LENGTH - 1, offsets[1])
            yield data[at:to], np.array([0, to - at]), np.zeros(1, np.int64), np.array([at - offsets[0]])
    else:
        yield data[offsets[0] : offsets[-1]], offsets - offsets[0], np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that are frequent in this task's inspected slices; the count of bytes inspected has no hash, that of all bytes is negative."""
    keys, counts, inspected, every, number = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0, 0
    for batch in batches:
        for part in slices(batch):
            for data, _, _, _ in _pieces(part):
                every += len(data)
                number += 1
                if number % INSPECTED != 1 or len(data) < SEED:
                    continue
                inspected += len(data)
                new, n = np.unique(seed_hashes(data), return_counts=True)
                keys, place = np.unique(np.concatenate([keys, new[n > 1]]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n[n > 1]])).astype(np.int64)
                # far below the share wanted, so the table is bounded
                enough = counts >= max(2, inspected * HOT_SHARE / 4)
                keys, counts = keys[enough], counts[enough]
    yield pa.RecordBatch.from_arrays([pa.array([None, None, *keys.view(np.int64).tolist()], pa.int64()), pa.array([inspected, -every, *counts.tolist()], pa.int64())], ["hash", "n"])


def frequent_hashes(docs: DataFrame) -> tuple[Hot, int]:
    """The hashes above HOT_SHARE (at most 1 / HOT_SHARE, for they share the whole) and the bytes of all texts."""
    found = landed(docs.select("text").mapInArrow(_frequent, "hash bigint, n bigint"), "repeats-frequent")
    total = found.filter("hash IS NULL").agg(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.sum(F.when(F.col("n") < 0, -F.col("n")))).first()
    hot = found.filter("hash IS NOT NULL").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") > (total[0] or 0) * HOT_SHARE)
    return Hot([r[0] for r in hot.select("hash").collect()]), total[1] or 0


def _place(check: np.ndarray, start: np.ndarray, windows: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """23 bits that tell texts of one id apart, 32 of the start, 7 of the number of windows less one, and a flag, as one number."""
    return check << 40 | start << 8 | windows - 1 << 1 | flag


def _start(place: np.ndarray) -> np.ndarray:
    return place >> 8 & 0xFFFFFFFF


def _windows(place: np.ndarray) -> np.ndarray:
    return (place >> 1 & 0x7F) + 1


SEGMENTS = "shard int, block binary"


def _block(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, byte by byte, compressed."""
    table = np.stack(columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(table.view(np.uint8).reshape(*table.shape, 8).transpose(0, 2, 1).tobytes(), CODEC, asbytes=True)


def _unblocked(block: bytes, columns: int) -> np.ndarray:
    n = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(pa.decompress(block[8:], columns * n * 8, CODEC, asbytes=True), np.uint8)
    return raw.reshape(columns, 8, n).transpose(0, 2, 1).copy().view(np.int64).reshape(columns, n)


def _segments(data: np.ndarray, offsets: np.ndarray, hot: Hot) -> tuple[np.ndarray, ...]:
    """Segments of texts: number of the text, start in ``data``, windows, anchor, content hash, whether windows may be equal within."""
    h = seed_hashes(data)
    rank = hot.demoted(h)
    least = least_of(rank, LENGTH - SEED + 1)
    n = len(least)
    # a window is valid if it ends in its text
    change = np.zeros(n + 1, np.int64)
    long = np.diff(offsets) >= LENGTH
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(change[:n]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    new[offsets[:-1][long]] = True
    new |= valid & ((np.arange(n) - first_of(new)) % RUN == 0)
    start = np.flatnonzero(new)
    windows = np.add.reduceat(valid.astype(np.int64), start) if len(start) else start
    again = np.zeros(n, bool)  # the anchor leaves at the front and is in the next window once more
    again[:-1] = (rank[: n - 1] == least[:-1]) & (least[1:] == least[:-1]) & valid[:-1] & valid[1:]
    inside = np.maximum.reduceat(again, start) if len(start) else again[:0]
    last = windows + LENGTH - 1 - SEED  # of the hashes inside
    seg = windows.astype(np.uint64)
    for k in range(-(-(RUN + LENGTH - 1) // SEED)):
        seg = mix(seg * np.uint64(BASE) + h[start + np.minimum(k * SEED, last)])
    return np.searchsorted(offsets, start, "right") - 1, start, windows, least[start], seg, inside


def _segment_rows(hot: Hot, shards: int):
    """Segments of each slice as one block for each shard that has any; blocks, not rows, are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, PIECE):
                ids, check = part.column(0).to_numpy(), part.column(1).to_numpy()
                for data, offsets, rows, begins in _pieces(part):
                    if len(data) < LENGTH:
                        continue
                    text, start, windows, anchor, seg, inside = _segments(data, offsets, hot)
                    doc = ids[rows[text]]
                    place = _place(check[rows[text]], start - offsets[text] + begins[text], windows, inside.astype(np.int64))
                    # copies within a slice leave the first, marked as one of several
                    order = np.lexsort((place, _start(place), doc, seg, anchor))
                    once = np.ones(len(order), bool)
                    once[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (anchor, seg, doc, place)], axis=0)
                    order = order[once]  # a row that is there twice is there once
                    anchor, seg, doc, place = anchor[order], seg[order], doc[order], place[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])
                    lead = first_of(new)
                    copy = (doc > doc[lead]) | (_start(place) > _start(place)[lead])
                    place[lead[copy]] |= 1
                    # a copy needs no company, it goes anywhere
                    shard = (np.where(copy, mix(seg + place.view(np.uint64)), mix(anchor)) % np.uint64(shards)).astype(np.int64)
                    order = np.lexsort((_start(place), doc, shard))
                    columns = [x[order] for x in (anchor.view(np.int64), seg.view(np.int64), doc, place, copy.astype(np.int64))]
                    has, edges = np.unique(shard[order], return_index=True)
                    blocks = [_block([c[a:b] for c in columns]) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)])]
                    yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the segments of a shard: copies, and the entries of anchors that occur more than once."""
    blocks = [_unblocked(x.as_buffer().to_pybytes(), 5) for b in batches for x in b.column(1)]
    anchor, seg, doc, place, copy = np.concatenate(blocks, axis=1) if blocks else np.zeros((5, 0), np.int64)
    copy = copy.astype(bool)
    away = np.flatnonzero(copy)
    here = np.flatnonzero(~copy)
    order = here[np.lexsort((_start(place[here]), doc[here], seg[here], anchor[here]))]
    a, s, d, p = anchor[order], seg[order], doc[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    lead = first_of(new)
    later = (d > d[lead]) | (_start(p) > _start(p)[lead])
    group = np.ones(len(order), bool)
    group[1:] = a[1:] != a[:-1]
    edges = np.flatnonzero(group)
    shared = np.repeat((np.diff(np.append(edges, len(a))) > 1) | (np.maximum.reduceat(p & 1, edges) > 0 if len(edges) else False), np.diff(np.append(edges, len(a)))) if len(a) else group
    entry = np.flatnonzero(shared & ~later)
    gone = np.concatenate([away, order[later]])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([np.zeros(len(gone), np.int64), a[entry]])), pa.array(np.concatenate([doc[gone], d[entry]])), pa.array(np.concatenate([place[gone], p[entry]])), pa.array(np.arange(len(gone) + len(entry)) >= len(gone))],
        ["anchor", "doc", "place", "entry"],
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2)
        offsets, data = buffers(texts)
        raw = [data[a:b].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array([pa.compress(r, CODEC, asbytes=True) for r in raw], pa.binary())], ["doc", "check", "n_bytes", "packed"]
        )


def _unpacked(batch: pa.RecordBatch, size: int, packed: int) -> Iterator[bytes]:
    for n, p in zip(batch.column(size).to_pylist(), batch.column(packed)):
        yield pa.decompress(p.as_buffer(), n, CODEC, asbytes=True)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of entries."""
    for batch in batches:
        wanted = batch.column(3)
        anchor, place = (x.to_numpy() for x in wanted.flatten().flatten())
        count = np.diff(wanted.offsets.to_numpy())
        start = _start(place)
        end = start + _windows(place) + LENGTH - 1
        cut: list[bytes] = []
        for text, n in zip(_unpacked(batch, 1, 2), count.tolist()):
            at = len(cut)
            cut += [text[a:b] for a, b in zip(start[at : at + n].tolist(), end[at : at + n].tolist())]
        doc = np.repeat(batch.column(0).to_numpy(), count)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc), pa.array(place), pa.array(cut, pa.binary())], ["anchor", "doc", "place", "text"])


def repeated_windows(texts: list[bytes], doc: np.ndarray, place: np.ndarray, block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of entries that may match each other: which entry, and the place of each run of windows that also start earlier."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    windows = size - LENGTH + 1
    which = np.repeat(np.arange(len(texts)), windows)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begin[which] + inner
    # where a window starts, as one number that orders like (document, start)
    key = np.unique(doc, return_inverse=True)[1][which] << 32 | _start(place)[which] + inner
    found = Suffixes(np.frombuffer(b"".join(texts), np.uint8))
    number = np.zeros(int(size.sum()), np.int64)
    number[starts] = np.arange(len(starts))
    again = np.zeros(len(starts), bool)
    for at, new in found.blocks(starts, *([block] if block else [])):
        row = number[at]
        edges = np.flatnonzero(found.classes(at, new, LENGTH))
        first = np.repeat(np.minimum.reduceat(key[row], edges), np.diff(np.append(edges, len(row))))
        again[row] = key[row] > first
    # runs of repeats within an entry
    new = again.copy()
    new[1:] &= ~again[:-1] | (which[1:] != which[:-1])
    lead = np.flatnonzero(new)
    n = np.add.reduceat(again.astype(np.int64), lead) if len(lead) else lead
    return which[lead], _place(place[which[lead]] >> 40, _start(place[which[lead]]) + inner[lead], n, np.zeros(len(lead), np.int64))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: whole groups of anchors are sorted together, up to SORTED_BYTES and one group more."""
    rows: list[tuple] = []
    size = 0

    def solved() -> pa.RecordBatch:
        doc = np.array([r[1] for r in rows], np.int64)
        which, place = repeated_windows([r[3] for r in rows], doc, np.array([r[2] for r in rows], np.int64))
        return pa.RecordBatch.from_arrays([pa.array(doc[which]), pa.array(place)], ["doc", "place"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if size >= SORTED_BYTES and row[0] != rows[-1][0]:
                yield solved()
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield solved()


CHECK = "shiftright(place, 40)"


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, place): runs of windows that also start earlier, of documents (doc, check, text)."""
    hot, size = frequent_hashes(docs)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    found = docs.mapInArrow(_segment_rows(hot, tasks), SEGMENTS).repartitionById(tasks, "shard")
    met = landed(found.mapInArrow(_entries, "anchor bigint, doc bigint, place bigint, entry boolean"), "repeats-entries")
    wanted = met.filter("entry").groupBy("doc", F.expr(CHECK).alias("check")).agg(F.collect_list(F.struct("anchor", "place")).alias("wanted"))
    texts = packed(docs).join(wanted, ["doc", "check"]).select("doc", "n_bytes", "packed", "wanted").mapInArrow(_wanted, "anchor bigint, doc bigint, place bigint, text binary")
    solved = texts.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(_sorted, "doc bigint, place bigint")
    return met.filter("NOT entry").select("doc", "place").unionByName(solved)


def packed(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_packed, "doc bigint, check bigint, n_bytes bigint, packed binary")


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def covered(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of the maximal runs that windows cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, _start(places), 1)
    np.add.at(change, _start(places) + _windows(places) + LENGTH - 1, -1)
    edge = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for k, text in enumerate(_unpacked(batch, 1, 2)):
            places = batch.column(3)[k]
            first, end = covered(places.values.to_numpy(), len(text)) if places.is_valid else (np.zeros(0, np.int64),) * 2
            kept = hashlib.sha256()
            for a, b in zip([0, *end.tolist()], [*first.tolist(), len(text)]):
                kept.update(text[a:b])
            out.append((len(text), int((end - first).sum()), len(first), kept.hexdigest()))
        ids = [None if d == NO_ID else d for d in batch.column(0).to_pylist()]
        made = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [pa.int64()] * 3 + [pa.string()])]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = df.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.crc32(text.cast("binary")).bitwiseAND(F.lit((1 << 23) - 1)).alias("check"), text.alias("text"))
    long = docs.filter(F.octet_length("text") >= LENGTH)
    places = repeats(long).groupBy("doc", F.expr(CHECK).alias("check")).agg(F.collect_list("place").alias("places"))
    cut = packed(long).join(places, ["doc", "check"], "left").select("doc", "n_bytes", "packed", "places").mapInArrow(_kept, RESULT)
    size = F.octet_length("text").cast("bigint")
    none = F.lit(0).cast("bigint")
    short = docs.filter(F.octet_length("text") < LENGTH).select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
    return cut.unionByName(short)
