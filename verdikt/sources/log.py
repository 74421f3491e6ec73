"""Response log with a manifest: appends that may be retried, and compaction of their files.

An append writes its rows to a folder of its own and then one manifest row (batch, folder, level, at).  Readers take only what the
manifest names, so files of an append that died do not count.  Of several attempts at a batch the one committed first counts; if
two commit at the same instant, the one whose folder has the smaller name.  A batch that is committed already is not written again.

Compaction writes the rows of all committed batches, each with its batch, to few files, and names them for their batches one
level higher; for every batch the highest level counts, so an append that runs meanwhile is neither lost nor doubled.  Replaced
files stay until ``drop_replaced``, for readers that began before.

The manifest has one row per append and per batch compacted; it is never collected, but joined to the rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

MANIFEST = "batch string, folder string, level int, at timestamp"
BATCH, FOLDER = "_batch", "folder"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """All manifest rows; none if nothing was ever committed."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, folder, level): the folder that counts for each committed batch."""
    best = F.min_by(F.struct("folder", "level"), F.struct(-F.col("level"), "at", "folder"))
    return _manifest(spark, path).groupBy("batch").agg(best.alias("_b")).select("batch", "_b.*")


def _write(df: DataFrame, path: str, fmt: str) -> str:
    folder = uuid.uuid4().hex
    df.write.format(fmt).save(f"{path}/rows/{FOLDER}={folder}")
    return folder


def append_batch(df: DataFrame, path: str, batch: str, fmt: str = "json") -> bool:
    """Add the rows of a batch to the log, unless it is there; tells whether rows were added.

    The columns ``_batch`` and ``folder`` are the log's own and must not be in ``df``.
    """
    if clash := {BATCH, FOLDER} & set(df.columns):
        raise ValueError(f"the log has columns of its own of these names: {sorted(clash)}")
    spark = df.sparkSession
    if not _manifest(spark, path).filter(F.col("batch") == batch).isEmpty():
        return False
    folder = _write(df.withColumn(BATCH, F.lit(batch)), path, fmt)
    row = spark.range(1).select(F.lit(batch).alias("batch"), F.lit(folder).alias("folder"), F.lit(0).alias("level"), F.current_timestamp().alias("at"))
    row.write.mode("append").json(f"{path}/manifest")
    return True


def _rows(spark: SparkSession, path: str, schema: StructType | str, fmt: str) -> DataFrame:
    """The committed rows with their batch."""
    given = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = StructType([*given.fields]).add(BATCH, "string").add(FOLDER, "string")
    live = committed(spark, path).select(F.col("batch").alias(BATCH), FOLDER)
    try:
        rows = spark.read.schema(full).format(fmt).load(f"{path}/rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], full)
    return rows.join(live, [BATCH, FOLDER], "left_semi").drop(FOLDER)


def read_log(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json") -> DataFrame:
    """All committed rows of the log, those of every batch once; an absent log is empty."""
    return _rows(spark, path, schema, fmt).drop(BATCH)


def compact(spark: SparkSession, path: str, schema: StructType | str, files: int, fmt: str = "json") -> str | None:
    """Write the committed rows anew to at most ``files`` files, rows dealt evenly; the name of the new folder, None for an empty log.

    Batches to replace are read from the manifest once and written with the new level, so one that is appended meanwhile is
    left as it is.
    """
    now = committed(spark, path)
    if now.isEmpty():
        return None
    state = f"{path}/plans/{uuid.uuid4().hex}"
    now.write.json(state)  # the batches of this compaction, fixed
    planned = spark.read.schema("batch string, folder string, level int").json(state)
    rows = _rows(spark, path, schema, fmt).join(planned.select(F.col("batch").alias(BATCH)), BATCH, "left_semi")
    folder = _write(rows.repartition(files), path, fmt)
    level = planned.agg(F.max("level") + 1).first()[0]
    done = planned.select("batch", F.lit(folder).alias("folder"), F.lit(level).alias("level"), F.current_timestamp().alias("at"))
    done.coalesce(1).write.mode("append").json(f"{path}/manifest")  # one small file, so that all batches change together
    return folder


def replaced(spark: SparkSession, path: str) -> DataFrame:
    """Folders that the manifest names and that count for no batch any more."""
    every = _manifest(spark, path).select("folder").distinct()
    return every.join(committed(spark, path).select("folder"), "folder", "left_anti")


def drop_replaced(spark: SparkSession, path: str) -> int:
    """Remove replaced folders, one by one; the number removed.  Not for logs that readers of an older state still read."""
    system = None
    n = 0
    for r in replaced(spark, path).toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/{FOLDER}={r.folder}")
        system = system or folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        n += bool(system.delete(folder, True))
    return n
