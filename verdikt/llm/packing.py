"""Best-fit packing of documents into training sequences of several permitted lengths.

Pieces of one length are interchangeable, so the choice is made on the histogram of lengths, which the largest
permitted length bounds: best-fit decreasing over runs of equal bins.  A piece that fits no open bin opens one of the
size whose cost per token that the remaining histogram can still put into it is least; at the end each bin shrinks to
the smallest permitted length that holds its contents.  Spark counts the histogram, numbers the pieces of each length
without gaps, and joins the numbers with the ranges of the plan.

A document has its words and one end token; one longer than the largest length is cut into whole sequences and a rest.

Defined results: null and empty texts are one token; rows without doc_id and repeated rows are packed like others; an
empty table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..session import landed
from .text import BLANK_RE

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces of one length that are numbered and joined together.
RANGE = 4096

PLAN = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("length", "first_piece", "pieces", "per_bin", "first_bin", "offset", "capacity", "fill")]
)


def sequence_cost(length: int) -> float:
    """Cost of one sequence: linear work and attention, which grows with the square."""
    return length * (1 + length / 16384)


class Run:
    """Equal bins ``first`` to ``first + n - 1``: capacity, free room, and what was put in: (length, first piece, per bin, offset, its first bin)."""

    __slots__ = ("first", "n", "capacity", "free", "parts")

    def __init__(self, first: int, n: int, capacity: int, free: int, parts: tuple):
        self.first, self.n, self.capacity, self.free, self.parts = first, n, capacity, free, parts


def least_cost(length: int, left: dict[int, int], lengths: Sequence[int], cost: Callable[[int], float]) -> int:
    """Permitted length with the least cost per token, if it is filled greedily with what is left (at least ``length``)."""
    sizes = sorted(left)
    best = None
    for cap in lengths:
        if cap < length:
            continue
        free, taken = cap - length, {length: 1}
        while free > 0:
            k = bisect_left(sizes, free + 1) - 1
            while k >= 0 and left[sizes[k]] <= taken.get(sizes[k], 0):
                k -= 1
            if k < 0:
                break
            x = sizes[k]
            q = min(free // x, left[x] - taken.get(x, 0))
            taken[x] = taken.get(x, 0) + q
            free -= q * x
        shrunk = min(c for c in lengths if c >= cap - free)
        rate = cost(shrunk) / (cap - free)
        if best is None or rate < best[0]:
            best = (rate, cap)
    return best[1]


def plan_bins(histogram: dict[int, int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> list[tuple[int, ...]]:
    """Rows of PLAN: ``pieces`` of a length, from ``first_piece`` on, go ``per_bin`` each into bins from ``first_bin`` on."""
    lengths = sorted(lengths)
    left = dict(histogram)
    open_at: dict[int, list[Run]] = {}
    rooms: list[int] = []
    bins = 0

    def put(run: Run) -> None:
        if run.n:
            if run.free not in open_at:
                open_at[run.free] = []
                insort(rooms, run.free)
            open_at[run.free].append(run)

    def fill(run: Run, length: int, piece: int, count: int) -> int:
        """Bins of the run take as many pieces as fit, one bin after the other; returns how many pieces went in."""
        q = run.free // length
        whole = min(run.n, count // q)
        if whole:
            put(Run(run.first, whole, run.capacity, run.free - q * length, (*run.parts, (length, piece, q, run.capacity - run.free, run.first))))
        used, rest = whole * q, count - whole * q
        at = run.first + whole
        if whole < run.n and rest:
            put(Run(at, 1, run.capacity, run.free - rest * length, (*run.parts, (length, piece + used, rest, run.capacity - run.free, at))))
            used, at = used + rest, at + 1
        put(Run(at, run.first + run.n - at, run.capacity, run.free, run.parts))
        return used

    for length in sorted(histogram, reverse=True):
        piece, count = 0, histogram[length]
        while count:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                run = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(k)
            else:
                left[length] = count
                cap = least_cost(length, left, lengths, cost)
                n = max(1, count // (cap // length))
                run = Run(bins, n, cap, cap, ())
                bins += n
            used = fill(run, length, piece, count)
            piece, count = piece + used, count - used
        del left[length]
    rows = []
    for run in (r for rs in open_at.values() for r in rs):
        content = run.capacity - run.free
        capacity = min(c for c in lengths if c >= content)
        rows += [(length, piece + (run.first - at) * q, run.n * q, q, run.first, offset, capacity, content) for length, piece, q, offset, at in run.parts]
    return rows


def _pieces(docs: DataFrame, longest: int) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[^" + BLANK_RE[1:] + "+"))
    d = docs.select("doc_id", (words.cast("bigint") + 1).alias("n_tokens"))
    whole = F.expr(f"(n_tokens - 1) div {longest}")
    return d.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), whole)).alias("piece")).withColumn(
        "length", F.least(F.lit(longest).cast("bigint"), F.col("n_tokens") - F.col("piece") * longest)
    )


def packed(docs: DataFrame, lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> DataFrame:
    """One row per piece: doc_id, piece, first token in the document, length, bin, its capacity and contents, place in it."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = _pieces(docs, max(lengths)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(4 * parts)))
    pieces = landed(pieces, "packing-pieces")
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = landed(sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))), "packing-sizes")
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("size").alias("n")).collect()}  # at most max(lengths) rows
    plan = _table(spark, plan_bins(histogram, lengths, cost))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    numbered = (
        pieces.withColumn("rank", F.row_number().over(within) - 1)
        .join(sizes.select("length", "bucket", "start"), ["length", "bucket"])
        .withColumn("number", F.col("start") + F.col("rank"))
        .withColumn("part", F.floor(F.col("number") / RANGE))
    )
    ranges = plan.withColumn("part", F.explode(F.sequence(F.floor(F.col("first_piece") / RANGE), F.floor((F.col("first_piece") + F.col("pieces") - 1) / RANGE))))
    inside = (F.col("number") >= F.col("first_piece")) & (F.col("number") < F.col("first_piece") + F.col("pieces"))
    rank = F.col("number") - F.col("first_piece")
    return (
        numbered.join(ranges, ["length", "part"])
        .filter(inside)
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * max(lengths)).alias("first_token"),
            "length",
            (F.col("first_bin") + F.expr("(number - first_piece) div per_bin")).alias("bin"),
            "capacity",
            "fill",
            (F.col("offset") + F.pmod(rank, F.col("per_bin")) * F.col("length")).alias("place"),
        )
    )


def _table(spark: SparkSession, rows: list[tuple[int, ...]]) -> DataFrame:
    return spark.createDataFrame(rows, PLAN)
