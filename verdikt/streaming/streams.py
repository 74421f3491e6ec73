"""Structured Streaming over the response log and over arriving steps.

All results go to a file sink in append mode: exactly once, restartable from the checkpoint, and no state
is collected on the driver.  Windows are written when the watermark has passed them; a log that has ended is closed by
one row far behind it (``closing_time``), which lets the watermark pass all that is open and opens a window that is
never written itself.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import parse as P
from ..functions.text import n_where, ratio
from ..operators.scoring import grade


def open_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Stream of the files below a path, with the schema of those that are there now."""
    r = spark.readStream.schema(spark.read.format(fmt).load(path).schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def run_available(df: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process what has arrived, then stop; the next run goes on from the checkpoint."""
    q = df.writeStream.format(fmt).outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()


def closing_time(df: DataFrame, ts: str = "ts", after: str = "365 days") -> Column:
    """Time of a row that closes a log: later than any window or gap that may still be open."""
    last = df.agg(F.max(ts).alias("last")).first().last
    return F.lit(last) + F.expr(f"INTERVAL {after}")


def accuracy_so_far(periods: DataFrame, keys: tuple[str, ...] = ("model", "task")) -> DataFrame:
    """Counts and accuracy from the first period on, from the rows that ``running_accuracy`` has written.

    There is one row per period and key, however many answers came.
    """
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    totals = {c: F.sum(c).over(w) for c in ("n", "n_correct", "n_error")}
    return periods.withColumns(totals).withColumn("accuracy", F.round(ratio(F.col("n_correct"), F.col("n")), 6))


def first_answers(log: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """The first answer of each model and uid to arrive; duplicates up to ``delay`` later are dropped."""
    return log.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["model", "uid"])


def read_log(log: DataFrame, error_prefix: str = P.ERROR_PREFIX) -> DataFrame:
    """Answers of a log with their readings; texts stay behind."""
    flagged = log.withColumn("is_error", P.is_error("ok", "error", "raw", error_prefix)).withColumn("answered", F.lit(True))
    return P.read_answers(flagged, P.scored_text("raw", "pred")).drop("raw", "pred", "error", "ok")


def graded(parsed: DataFrame, gold: DataFrame) -> DataFrame:
    """Readings with the static gold row of their uid, graded; an answer without gold has no task and is no right one."""
    reading = (
        F.when(F.col("task") == "A", F.col("as_letter"))
        .when(F.col("task").isin("C", "D"), F.col("as_verdict"))
        .when(F.col("task") == "E", F.col("as_json"))
    )
    return grade(parsed.join(gold, "uid", "left").withColumn("_read", reading))


def _counts() -> list[Column]:
    return [F.count("*").alias("n"), n_where(F.col("correct")).alias("n_correct"), n_where(F.col("failure") == "api_error").alias("n_error")]


def running_accuracy(log: DataFrame, gold: DataFrame, every: str, delay: str, error_prefix: str = P.ERROR_PREFIX) -> DataFrame:
    """Answers joined to static gold and graded; counts per period, model and task add up to the accuracy so far.

    Answers without gold are counted with a null task.
    """
    answers = graded(read_log(log, error_prefix).withWatermark("ts", delay), gold)
    per_period = answers.groupBy(F.window("ts", every).alias("w"), "model", "task").agg(*_counts())
    return per_period.select(F.col("w.start").alias("period"), "model", "task", "n", "n_correct", "n_error")


class RunningTotals:
    """Counts per model and task that are right after every trigger, in two tables below ``path``.

    A batch writes its own folder of both: ``counts`` of the answers that have gold, and the readings of those that are
    ``waiting`` for it.  A batch that runs again replaces its folder, so no answer counts twice.  ``totals`` adds up the
    counts and grades what waits against the gold of the moment; gold that comes late needs no second pass over the log.
    """

    COUNTS = "model string, task string, n bigint, n_correct bigint, n_error bigint, batch bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def _waiting_schema(self):
        letter = "struct<value: string, mode: string>"
        return f"uid string, model string, is_error boolean, answered boolean, as_letter {letter}, as_verdict {letter}, as_json {letter}, batch bigint"

    def _table(self, table: str, schema: str) -> DataFrame:
        """All folders of a table; before the first batch there are none."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}") if there else self.spark.createDataFrame([], schema)

    def add(self, batch: DataFrame, number: int, gold: DataFrame) -> None:
        """One batch of readings (``read_log``)."""
        keep = ["uid", "model", "is_error", "answered", "as_letter", "as_verdict", "as_json"]
        known = gold.select("uid", "task", "gold")
        rows = batch.select(*keep).join(known.select("uid", F.lit(True).alias("_has_gold")), "uid", "left").persist()
        try:
            self._write(graded(rows.filter("_has_gold").drop("_has_gold"), known).groupBy("model", "task").agg(*_counts()), "counts", number)
            self._write(rows.filter("_has_gold IS NULL").drop("_has_gold"), "waiting", number)
        finally:
            rows.unpersist()

    def follow(self, log: DataFrame, gold: DataFrame, checkpoint: str, error_prefix: str = P.ERROR_PREFIX) -> None:
        """Take in what has arrived on a stream, then stop; the next run goes on from the checkpoint."""
        q = read_log(log, error_prefix).writeStream.foreachBatch(lambda batch, number: self.add(batch, number, gold))
        q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def totals(self, gold: DataFrame) -> DataFrame:
        """model, task, n, n_correct, n_error so far; answers that still lack gold have a null task."""
        counted = self._table("counts", self.COUNTS).drop("batch")
        late = graded(self._table("waiting", self._waiting_schema()).drop("batch"), gold.select("uid", "task", "gold"))
        rows = counted.unionByName(late.groupBy("model", "task").agg(*_counts()))
        return rows.groupBy("model", "task").agg(*[F.sum(c).alias(c) for c in ("n", "n_correct", "n_error")])


def throughput(calls: DataFrame, window: Column, delay: str) -> DataFrame:
    """Calls and failed calls per window and model, for tumbling or sliding windows."""
    return (
        calls.withWatermark("ts", delay)
        .groupBy(window.alias("w"), "model")
        .agg(F.count("*").alias("n_calls"), n_where(~F.col("ok")).alias("n_errors"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "model", "n_calls", "n_errors")
    )


def sessions(calls: DataFrame, gap: str, delay: str, key: str) -> DataFrame:
    """Bursts of calls per key: a session ends when nothing comes for ``gap``."""
    return (
        calls.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.count("*").alias("n_calls"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n_calls")
    )


EVENT_SCHEMA = "group_id string, t bigint, kind string, label string"
STATE_SCHEMA = "rows binary"
STEPS = pa.schema([("group_id", pa.string()), ("t", pa.int64()), ("carry", pa.string()), ("at", pa.int64())])
CARRIED = pa.schema([("group_id", pa.string()), ("carry", pa.string()), ("held", pa.list_(pa.string())), ("at", pa.int64())])
#: Keys of the tracker's state, which must stay the same as long as a checkpoint is used.
BUCKETS = 512
DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _block(columns: list, schema: pa.Schema) -> tuple[bytes]:
    """Rows as one value of the state."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema)], schema=schema))
    return (out.getvalue().to_pybytes(),)


def _block_rows(block: bytes) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in pa.ipc.open_stream(block).read_all().columns))


class EventTracker(StatefulProcessor):
    """Events of the groups of one bucket from steps that come in any order.

    A call into the state costs more than many steps do, so a key is a bucket of groups and the steps of a trigger are one
    value.  Steps are held until the watermark has passed their time; a timer at that time takes them out in order of ``t``.
    What a group carries and held before is kept for ``idle`` of event time after its last step (up to a day more), then dropped.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", STATE_SCHEMA)
        self.last = handle.getValueState("last", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            at = frame["ts"].astype("datetime64[ms]").astype("int64")
            self.waiting.appendValue(_block([frame["group_id"], frame["t"], frame["carry"], at], STEPS))
            first = at.min() if first is None else min(first, at.min())
        self.handle.registerTimer(int(first) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, now = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        steps = [s for block, in self.waiting.get() for s in _block_rows(block)]
        due, rest = sorted((s for s in steps if s[3] <= passed), key=lambda s: s[1]), [s for s in steps if s[3] > passed]
        kept = self.last.get()
        known = {g: (carry, set(held), at) for g, carry, held, at in _block_rows(kept[0])} if kept else {}
        out = []
        for group, t, thing, at in due:
            carry, held, last = known.get(group) or (None, set(), at)
            if thing is not None and carry is None:
                out.append((group, t, "reacquire" if thing in held else "pickup", thing))
                held.add(thing)
            elif thing is None and carry is not None:
                out.append((group, t, "drop", carry))
                held.add(carry)
            known[group] = (thing, held, max(last, at))
        if due:
            if rest:
                self.waiting.put([_block(list(zip(*rest)), STEPS)])
            else:
                self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(s[3] for s in rest) + 1)
        busy = {s[0] for s in rest}
        idle = [g for g, (_, _, last) in known.items() if last + self.idle_ms <= now and g not in busy]
        for group in idle:
            del known[group]
        if known and (due or idle):
            self.last.update(_block(list(zip(*((g, carry, sorted(held), last) for g, (carry, held, last) in known.items()))), CARRIED))
        elif idle:
            self.last.clear()
        if known:
            # whole days, so that the timers of one day are one
            ends = max(min(last for _, _, last in known.values()) + self.idle_ms, now + 1)
            self.handle.registerTimer(-(-ends // DAY_MS) * DAY_MS)
        return iter([pd.DataFrame(out, columns=["group_id", "t", "kind", "label"])] if out else [])

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_in_rocks(spark: SparkSession) -> Iterator[None]:
    """List state and timers need the RocksDB store; the session's own choice comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def track_events(steps: DataFrame, delay: str, idle: str = "30 days", ts: str = "ts", buckets: int = BUCKETS) -> DataFrame:
    """pickup, reacquire and drop events of steps (group_id, t, carry, ts) that may come up to ``delay`` late.

    Times rise with ``t`` within a group.  Steps later than ``delay`` are dropped, as by any watermark; start the query inside
    ``state_in_rocks``.  A task holds one bucket's waiting steps at a time; the events do not depend on ``buckets``.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    bucket = F.pmod(F.xxhash64("group_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = steps.select(bucket, "group_id", "t", "carry", F.col(ts).alias("ts")).withWatermark("ts", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(EventTracker(idle_ms), EVENT_SCHEMA, "append", "eventTime")
