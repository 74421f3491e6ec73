"""Compressed codes of embedding vectors: each of 16 parts is named by its nearest codebook entry, found by Orchard search.

Every entry has the list of all entries sorted by their distance from it.  A search walks the list of its best entry so far; an entry that
is nearer becomes the best and the walk goes on in its list; entries already met are marked and not measured again; the walk ends where
the list is beyond twice the current distance, for no entry there can be nearer or as near.  All vectors of a batch walk at once.

Codebooks are bounded by their parameters (entries × components) and travel with the tasks.  A task sends one row per entry and component
to the sums, whatever its number of vectors.  Sums of a label are worked out before they are joined, and the join is salted by vector.

Defined results: vectors that are null or hold a null or non-finite component are left out; the number of components is that of the vector
with the smallest vec_id, and vectors of another length stay with null code and error; lengths that 16 does not divide are cut as evenly as
can be; components beyond ±LIMIT after scaling count as ±LIMIT, so that distances fit a long; null ids come last; rows that share an id are
vectors of their own, ordered by their components in the first codebook; fewer vectors than entries give fewer entries; an empty table
gives an empty result; a label whose vectors have no error has a null sum; other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.joins import spread_join
from ..session import landed
from .centroids import finite, whole_numbers

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LIMIT = 1 << 23
#: Vectors that walk at once.
BATCH = 4096


class Orchard:
    """Nearest entries of one codebook by walks along lists sorted by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = ((entries[:, None] - entries[None]) ** 2).sum(-1)
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.order, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (of equally near ones the least) and squared distance, for each row of ``x``."""
        n, k = len(x), len(self.entries)
        best = np.zeros(n, np.int64)
        far = ((x - self.entries[0]) ** 2).sum(1)
        met = np.zeros((n, k), bool)
        met[:, 0] = True
        at = np.zeros(n, np.int64)
        walking = np.arange(n)
        while len(walking):
            # squares: beyond twice the distance is beyond four times its square
            walking = walking[self.gap[best[walking], at[walking]] <= 4 * far[walking]]
            entry = self.order[best[walking], at[walking]]
            at[walking] += 1
            new = ~met[walking, entry]
            row, entry = walking[new], entry[new]
            met[row, entry] = True
            d = ((x[row] - self.entries[entry]) ** 2).sum(1)
            nearer = (d < far[row]) | ((d == far[row]) & (entry < best[row]))
            row, entry = row[nearer], entry[nearer]
            best[row], far[row], at[row] = entry, d[nearer], 0
            walking = walking[at[walking] < k]
        return best, far


class Codebooks:
    """One codebook per part; ``cuts`` are the places where vectors are cut."""

    def __init__(self, vectors: np.ndarray, parts: int):
        self.components = vectors.shape[1]
        self.cuts = [p * self.components // parts for p in range(parts + 1)]
        self.books = [vectors[:, a:b].copy() for a, b in zip(self.cuts, self.cuts[1:])]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries (vectors × parts) and the squared distances summed over parts."""
        out = np.zeros((len(vectors), len(self.books)), np.int64)
        error = np.zeros(len(vectors), np.int64)
        for p, book in enumerate(self.books):
            search = Orchard(book)
            for i in range(0, len(vectors), BATCH):
                out[i : i + BATCH, p], d = search.nearest(vectors[i : i + BATCH, self.cuts[p] : self.cuts[p + 1]])
                error[i : i + BATCH] += d
        return out, error

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def _matrix(column: pa.Array, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with that many components, and their vectors."""
    rows = np.flatnonzero(np.diff(column.offsets.to_numpy()) == components)
    return rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), components)


def updated(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by its parts' mean, rounded down; entries without parts stay."""
    k, width = len(books.books[0]), books.components

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width), np.int64)
        count = np.zeros((k, len(books.books)), np.int64)
        for batch in batches:
            _, x = _matrix(batch.column(0), width)
            chosen, _ = books.nearest(x)
            for p, (a, b) in enumerate(zip(books.cuts, books.cuts[1:])):
                count[:, p] += np.bincount(chosen[:, p], minlength=k)
                np.add.at(total[:, a:b], chosen[:, p], x[:, a:b])
        size = count[:, np.repeat(np.arange(len(books.books)), np.diff(books.cuts))]
        entry, place = np.nonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(place), pa.array(total[entry, place]), pa.array(size[entry, place])], ["entry", "place", "total", "n"])

    out = Codebooks(np.hstack(books.books), len(books.books))
    per_task = vectors.select("q").mapInArrow(sums, "entry bigint, place bigint, total bigint, n bigint")
    for entry, place, total, n in per_task.groupBy("entry", "place").agg(F.sum("total"), F.sum("n")).collect():  # entries × components
        p = next(p for p, b in enumerate(out.cuts[1:]) if place < b)
        out.books[p][entry, place - out.cuts[p]] = total // n
    return out


def coded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of vectors (vec_id, label, q)."""
    kinds = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column(2), books.components)
            chosen, far = books.nearest(x)
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            code[rows] = [bytes(c).hex() for c in chosen.astype(np.uint8)]
            error[rows] = far.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], kinds.fieldNames())

    return vectors.select("vec_id", "label", "q").mapInArrow(run, kinds)


def compressed(df: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector; ``entries`` is at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is two hex digits: 1 to 256 entries")
    vector = F.col("embedding").cast("array<double>")
    vectors = landed(df.filter(vector.isNotNull() & finite(vector)).select("vec_id", "label", whole_numbers(vector, scale, LIMIT).alias("q")), "codes-vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    first = vectors.orderBy(*order).select(F.size("q")).first()
    if first is None:
        return vectors.filter("false").select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    start = vectors.filter(F.size("q") == first[0]).orderBy(*order).limit(entries).select("q").collect()
    books = Codebooks(np.array([r[0] for r in start], np.int64).reshape(len(start), first[0]), parts)
    for _ in range(rounds):
        books = updated(vectors, books)
    key = [F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    rows = landed(coded(vectors, books).select("vec_id", "code", "error", *key), "codes-coded")
    sums = rows.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"))
    out = spread_join(rows, sums, ["_none", "_label"], F.struct("vec_id", "code"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
