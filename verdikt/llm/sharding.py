"""Contiguous shards of near-equal bytes, in SQL functions only.

Documents are put in order of doc_id by ranges, and the ranges are written to the shared folder with their number (ids
and sizes, no texts).  Totals per range give each range its global offset by one small prefix sum; inside a range a
window does the rest.  A document goes to the shard that the middle of its bytes falls into when the whole is cut at
equal targets, so shards differ by less than one document from the target.

Defined results: a null text has no bytes and size 1; documents without doc_id come first; documents of one id are
ordered by checksum and size (repeated rows are alike and take neighbouring slots); an empty table gives an empty
result; other columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import landed

SHARDS = 16


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size", "spread"]
    # repeated rows are alike, so which of them gets which number does not matter
    sized = landed(sized.withColumn("spread", F.monotonically_increasing_id()), "sharding-sizes")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = landed(sized.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "sharding-ranges")

    # one row per range: a prefix sum over as many rows as there are partitions
    totals = d.groupBy("range").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"), F.sum("bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("range").orderBy(*order)
    placed = d.join(totals, "range").withColumn("upto", F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    middle = F.expr(f"((2 * upto - size) * {shards}) div (2 * total)")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), middle).cast("int"))

    # slots: at most ranges + shards pieces, numbered the same way
    pieces = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("shard", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("taken"))
    placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("range", "shard").orderBy(*order)) - 1)
    return placed.join(pieces, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("taken") + F.col("rank")).alias("slot"))


def laid_out(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return sharded(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
