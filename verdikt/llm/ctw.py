"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions.  Each decision has a node for every context of 0 to DEPTH preceding bytes (and the
bits of the byte so far); a node estimates by Krichevsky and Trofimov from its counts, and its weighted probability is
the mean of its own estimate and of what its longer contexts give.  Counts are gathered from all training texts; the
tree is then fixed, and the probability of a byte mixes all depths with the weights that the training texts left.  The
text is lower-cased (A-Z), each text begins after zero bytes and ends with one, which does not occur in words.

Neither the tree nor the token counts are ever in one place.  Documents are put into chunks of bounded bytes.  The
distinct symbols of a chunk (a byte and the DEPTH bytes before it) go to buckets by their two nearest bytes, in
compressed blocks; a bucket adds them up and holds whole subtrees, so it works out their weights.  What is above, at most
65,535 nodes, is summed by Spark and broadcast; then each bucket sends every chunk the log-probabilities of its symbols.
The model grows with the corpus, and the number of buckets with the chunks.  Tokens of the base score take the same way.
Blocks instead of one row per chunk and symbol keep what is shuffled small.

Defined results: null and empty texts are the end token alone; rows without doc_id are learned from; repeated rows count
each; with no training tokens the base score is that of unseen tokens; an empty table gives an empty result; other
columns are left behind.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import landed
from . import contexts as C
from .text import slices

DEPTH = 5
#: Bytes of text in a chunk whose symbols and tokens are looked up together.
CHUNK_BYTES = 8 << 20
END = b"\n"


def held_out_id(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class Tree:
    """A tree over contexts of two bytes in one process, from counts of (byte before last, last byte, byte)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        keys = keys.astype(np.int64)
        self.key, self.n = C.added_up([((keys >> 8 & 255) << 16 | (keys >> 16) << 8 | keys & 255, counts.astype(np.int64))])

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of each of the 65,536 contexts (last byte first), and the rows: log10 probabilities of 256 bytes."""
        every = np.arange(1 << 24)
        counts = np.zeros(len(every), np.int64)
        counts[self.key] = self.n
        above = C.upper(*C.summed(C.Subtree(self.key, self.n, C.TOP).top_nodes()))
        logs = [C.Subtree(every[k : k + (1 << 20)], counts[k : k + (1 << 20)], C.TOP).logs(above) for k in range(0, len(every), 1 << 20)]
        return np.arange(1 << 16), np.concatenate(logs).astype(np.float32).reshape(1 << 16, 256)


def scores(texts: pa.Array, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log10 probability of each text and its end by a table of contexts of two bytes."""
    key, first = C.symbols(texts, C.TOP)
    row, logs = table
    return np.add.reduceat(logs[row[key >> 8], key & 255], first, dtype=np.float64) if len(first) else np.zeros(0)


def _chunked(docs: DataFrame) -> DataFrame:
    """chunk and part: consecutive documents of a partition, of CHUNK_BYTES or one longer text, as compressed Arrow."""
    fields = ["doc_id", "text"]

    def row(chunk: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for part in parts:
                w.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["chunk", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch.select(fields)):
                more = part.column(1).nbytes
                if size and size + more > CHUNK_BYTES:
                    yield row(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
                size += more
                held.append(part)
        if held:
            yield row(chunk, held)

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "chunk bigint, part binary")


def _parts(chunk: pa.Scalar) -> Iterator[pa.RecordBatch]:
    """doc_id and text of a chunk, a bounded slice at a time."""
    with pa.ipc.open_stream(chunk.as_buffer()) as batches:
        yield from batches


#: Blocks: the tokens of a chunk that fall into one bucket, and a number for each.  Buckets below 0 hold symbols (-1 - bucket).
BLOCKS = "chunk bigint, bucket int, tokens binary, n binary"
_BLOCKS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("n", pa.binary())])
#: Buckets for each shuffle partition, at least; and chunks for each bucket, at most, so that a bucket stays as large.
BUCKETS = 4
CHUNKS = 4
#: Numbers of a bucket's rows in front of those of the chunks: its sum, the nodes of its subtrees' tops.
SUM, TOPS = -1, -2
#: Bytes of blocks that are handed on together.
BATCH_BYTES = 4 << 20


def _packed(values: list[bytes] | np.ndarray) -> bytes:
    """Tokens (without blanks inside) or numbers as one compressed block."""
    return zlib.compress(b" ".join(values) if isinstance(values, list) else np.ascontiguousarray(values, np.int64).tobytes(), 1)


def _tokens(block: bytes) -> list[bytes]:
    return zlib.decompress(block).split(b" ")


def _numbers(block: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(block), np.int64)


def _packed_sorted(key: np.ndarray) -> bytes:
    return _packed(np.diff(key, prepend=np.int64(0)))


def _sorted_numbers(block: bytes) -> np.ndarray:
    return np.cumsum(_numbers(block))


def _blocks(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS as batches of bounded bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r[2:] if x is not None) + 32
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), _BLOCKS)], schema=_BLOCKS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), _BLOCKS)], schema=_BLOCKS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def _dealt(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets of sorted symbols, and the places of each one's."""
    of = C.bucket_of(key, DEPTH, buckets)
    order = np.argsort(of, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(places):
            yield int(of[places[0]]), places


def _count_blocks(buckets: int):
    """Function that tells, of each chunk, its distinct tokens and symbols with their training counts."""

    def told(chunk: int, part: pa.Scalar) -> Iterator[tuple]:
        tokens, keys = Counter(), []
        for docs in _parts(part):
            held = [held_out_id(x) for x in docs.column(0).to_pylist()]
            texts = docs.column(1)
            for k, out in enumerate(held):
                words = texts[k].as_buffer().to_pybytes().lower().split()
                words.append(END)
                tokens.update(dict.fromkeys(words, 0) if out else words)
            for out in (False, True):
                key, n = np.unique(C.symbols(texts.filter(pa.array([x == out for x in held])), DEPTH)[0], return_counts=True)
                keys.append((key, n * (not out)))
        parts: dict[int, list[bytes]] = {}
        for w in sorted(tokens):
            parts.setdefault(zlib.crc32(w) % buckets, []).append(w)
        for b, ws in parts.items():
            yield chunk, b, _packed(ws), _packed(np.array([tokens[w] for w in ws]))
        key, n = C.added_up(keys)
        for b, places in _dealt(key, buckets):
            yield chunk, -1 - b, _packed_sorted(key[places]), _packed(n[places])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _blocks(told(chunk, part))

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus counts of each bucket's symbols, and the tops of its subtrees; rows come by bucket."""

    def told() -> Iterator[tuple]:
        for bucket, rows in groupby(_rows(batches), lambda r: r[1]):
            total, new, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
            for _, _, key, n in rows:
                new.append((_sorted_numbers(key), _numbers(n)))
                waiting += len(new[-1][0])
                if waiting > len(total[0]) + (1 << 20):
                    total, new, waiting = C.added_up([total, *new]), [], 0
            key, n = C.added_up([total, *new])
            yield SUM, bucket, _packed_sorted(key), _packed(n)
            tops = C.Subtree(key, n, DEPTH).top_nodes()
            yield TOPS, bucket, b"", _packed(C.summed(tops).ravel())

    yield from _blocks(told())


def _top_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _numbers(n).reshape(4, -1)], ["node", "weighted", "zero", "one"])


def _logs_back(above):
    """Function that sends every chunk the log-probabilities of its symbols; a bucket's sum comes before its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            for bucket, rows in groupby(_rows(batches), lambda r: r[1]):
                _, _, key, n = next(rows)
                key, n = _sorted_numbers(key), _numbers(n)
                logs = C.Subtree(key, n, DEPTH).logs(above.value).astype(np.float32)
                for chunk, _, asked, _ in rows:
                    yield chunk, bucket, None, logs[np.searchsorted(key, _sorted_numbers(asked))].tobytes()

        yield from _blocks(told())

    return run


def _corpus_counts(blocks: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's tokens, sent back to each chunk; and, as chunk -1, their sum and how many there are."""
    total: Counter = Counter()
    for tokens, n in zip(blocks["tokens"].to_pylist(), blocks["n"].to_pylist()):
        for w, k in zip(_tokens(tokens), _numbers(n).tolist()):
            total[w] += k
    known = [n for n in total.values() if n]
    rows = [(SUM, 0, b"", _packed(np.array([sum(known), len(known)])))]
    for chunk, tokens in zip(blocks["chunk"].to_pylist(), blocks["tokens"].to_pylist()):
        rows.append((chunk, 0, tokens, _packed(np.array([total[w] for w in _tokens(tokens)]))))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)


def scored(docs: DataFrame) -> DataFrame:
    """Base score and context-tree score of each document, learned from those that are not held out."""
    spark = docs.sparkSession
    d = landed(_chunked(docs), "ctw-chunks")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS * partitions, d.count() // CHUNKS)
    tasks = max(partitions, buckets // BUCKETS)
    blocks = landed(d.mapInArrow(_count_blocks(buckets), BLOCKS), "ctw-blocks")
    asked = blocks.filter("bucket < 0")
    sums = landed(asked.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_sums, BLOCKS), "ctw-sums")
    tops = sums.filter(F.col("chunk") == TOPS).select("n").mapInArrow(_top_rows, "node bigint, weighted bigint, zero bigint, one bigint")
    top = tops.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("weighted", "zero", "one")]).toArrow()  # at most 65,280 rows
    above = spark.sparkContext.broadcast(C.upper(*[top[c].to_numpy() for c in ("node", "weighted", "zero", "one")]))
    logs = sums.filter(F.col("chunk") == SUM).unionByName(asked.withColumn("n", F.lit(None).cast("binary")))
    logs = logs.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_logs_back(above), BLOCKS)
    counts = landed(blocks.filter("bucket >= 0").groupBy("bucket").applyInArrow(_corpus_counts, BLOCKS), "ctw-counts")
    found = [_numbers(bytes(r.n)) for r in counts.filter(F.col("chunk") == SUM).select("n").collect()]  # one row a bucket
    total, distinct = (int(sum(s[k] for s in found)) for k in (0, 1))
    floor = total + 0.5 * (distinct + 1)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *FIELDS])

    def chunk_scores(parts: pa.Table, replies: pa.Table) -> pa.Table:
        log: dict[bytes, float] = {}
        tree: dict[int, np.ndarray] = {}
        for bucket, tokens, n in zip(*(replies[c].to_pylist() for c in ("bucket", "tokens", "n"))):
            if bucket < 0:
                tree[-1 - bucket] = np.frombuffer(n, np.float32)
            else:
                log.update(zip(_tokens(tokens), np.log10((_numbers(n) + 0.5) / floor).tolist()))
        unseen = math.log10(0.5 / floor)
        rows = []
        for chunk in parts["part"]:
            found = [C.distinct(C.symbols(docs.column(1), DEPTH)) for docs in _parts(chunk)]
            key = np.unique(np.concatenate([f[0] for f in found]))
            value = np.empty(len(key), np.float32)
            for b, places in _dealt(key, buckets):
                value[places] = tree[b]
            for docs, (own, place, first) in zip(_parts(chunk), found):
                model = np.add.reduceat(value[np.searchsorted(key, own)][place], first, dtype=np.float64)
                for i, text, score in zip(docs.column(0).to_pylist(), docs.column(1), model.tolist()):
                    text = text.as_buffer().to_pybytes()
                    words = text.lower().split()
                    words.append(END)
                    x = np.fromiter(map(log.__getitem__, words), float, len(words))
                    rows.append((i, held_out_id(i), len(x), int((x > unseen).sum()), total, float(x.sum()), score, -score / math.log10(2) / (len(text) + 1)))
        kinds = [docs_type, *_ARROW]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=schema.fieldNames())

    docs_type = to_arrow_type(id_type)
    return d.groupBy("chunk").cogroup(counts.filter("chunk >= 0").unionByName(logs).groupBy("chunk")).applyInArrow(chunk_scores, schema)


FIELDS = [
    T.StructField("held_out", T.BooleanType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()),
    T.StructField("train_tokens", T.LongType()),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("bits_per_byte", T.DoubleType()),
]
_ARROW = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
