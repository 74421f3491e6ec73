"""Session helpers: builder for tests/benchmarks and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "verdikt", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings always win over these defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # partial sessions are merged before the shuffle, so a busy key sends few rows
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster shares (``spark.checkpoint.dir``), removed when the program ends.

    Without that setting a local master gets a temporary folder; on a cluster each machine would write to its own disk
    and the read back would miss rows, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir names no shared folder, which master {master} needs for intermediate tables")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{base.rstrip('/')}/verdikt-{name}-{uuid.uuid4().hex}"
    _remove_at_end(spark, path)
    return path


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder when the driver's program ends (not from a Connect client)."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def remove() -> None:
        with contextlib.suppress(Exception):  # the gateway may be gone already
            files.delete(folder, True)

    atexit.register(remove)


def landed(df: DataFrame, name: str) -> DataFrame:
    """A table that several branches of a query read, written once to the shared folder.

    The branches then start from files that survive lost executors, instead of repeating the work.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
