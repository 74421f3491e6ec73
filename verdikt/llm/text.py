"""Shared helpers: rows handed to Arrow functions in bounded slices, words and word hashes of whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

# The six separators of words, as characters for SQL and as byte numbers.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = "[ \\t\\n\\x0B\\f\\r]"


def is_word_byte() -> np.ndarray:
    """Table of bytes inside words that blanks separate; UTF-8 needs no decoding for that."""
    table = np.ones(256, bool)
    table[[32, *range(9, 14)]] = False
    return table


def is_alnum_byte() -> np.ndarray:
    """Table of bytes 0-9, A-Z, a-z and those of characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[128:] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        table[a:b] = True
    return table


def lower_byte() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_array(text: Column) -> Column:
    """SQL array of the words that blanks separate; null and empty texts have none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RE + "+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_texts(df: DataFrame, fn: Callable[[pa.Array], Sequence[pa.Array]], fields: T.StructType, keep: Sequence[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``df`` and the columns that ``fn`` works out from slices of its texts (null: empty).

    ``fn`` gets a string array without nulls of at most SLICE_BYTES, or of one longer text.
    """
    schema = T.StructType([df.schema[k] for k in keep] + list(fields))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = fn(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + list(made), names)

    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices; the last column is the text."""
    offsets, _ = buffers(batch.column(batch.num_columns - 1))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and bytes of a string array, without copying."""
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return off.astype(np.int64), data


class Words:
    """Words of a slice of texts: byte ranges ``start``:``end`` in ``data``, and the text each belongs to."""

    def __init__(self, texts: pa.Array, inside: np.ndarray, lower: np.ndarray | None = None):
        off, data = buffers(texts)
        base = off[0]
        self.data, self.offsets = data[base : off[-1]], off - base
        if lower is not None:
            self.data = lower[self.data]
        n = len(self.data)
        flag = inside[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = flag[:-1]
            after[:-1] = flag[1:]
        self.start = np.flatnonzero(flag & (~before | first[:n]))
        self.end = np.flatnonzero(flag & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)  # words of text i are bounds[i]:bounds[i+1]
        self.count = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, mixed."""
        power, inverse = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[self.data] * power[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])

    def strings(self, i: int) -> list[bytes]:
        """Words of text i."""
        raw = self.data.tobytes() if len(self.count) == 1 else None
        a, b = self.bounds[i], self.bounds[i + 1]
        if raw is None:
            lo = self.offsets[i]
            raw, s, e = self.data[lo : self.offsets[i + 1]].tobytes(), self.start[a:b] - lo, self.end[a:b] - lo
        else:
            s, e = self.start[a:b], self.end[a:b]
        return [raw[x:y] for x, y in zip(s.tolist(), e.tolist())]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[: len(h) - n + 1])


BASE = 0x9E3779B97F4A7C15 | 1
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]
