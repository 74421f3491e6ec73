"""Queries: the event table as a stream, written by a file sink and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_dir
from ..streaming import streams as T
from .fixtures import Fixtures
from .registry import query


PARTS = 4


def _arrived(fx: Fixtures, part: Column, name: str, repeats: bool = False) -> tuple[str, int]:
    """The events as files that arrive part after part, and the files of a part; ``part`` says in which one a row comes.

    With ``repeats`` every tenth row comes again, one part later, as another answer.  Each part is written by as many tasks as the
    table is read by, and a trigger takes as many files.
    """
    path = scratch_dir(fx.spark, name)
    e = fx.spark.read.parquet(f"{fx.dir}/events.parquet").withColumn("_part", part)
    files = e.rdd.getNumPartitions()
    e = e.withColumn("again", F.lit(False))
    if repeats:
        e = e.unionByName(e.filter("event_id % 10 = 0").withColumns({"_part": F.col("_part") + 1, "again": F.lit(True)}))
    for k in range(PARTS + repeats):
        e.filter(F.col("_part") == k).drop("_part").repartition(files).write.mode("append").parquet(path)
    # the row that closes the log
    last = e.filter("NOT again").orderBy("event_id").limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), "user_id": F.lit(-1).cast(e.schema["user_id"].dataType), "ts": T.closing_time(e)})
    last.drop("_part").write.mode("append").parquet(path)
    return path, files


def _by_time(fx: Fixtures) -> Column:
    """Parts of equal time; half of the rows of a part's last half hour come late, with the next part."""
    e = fx.spark.read.parquet(f"{fx.dir}/events.parquet")
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    width = (span.b - span.a).total_seconds() / PARTS + 1
    since = F.timestamp_diff("SECOND", F.lit(span.a).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    late = (F.pmod(since, F.lit(width)) > width - 1800) & (F.col("event_id") % 2 == 0)
    return F.least(F.lit(PARTS - 1), F.floor(since / width) + late.cast("int"))


class StreamFixtures(Fixtures):
    """The same views over tables that are read as streams, a part at a time."""

    def __init__(self, spark, sf_dir: str, path: str, files_per_trigger: int):
        super().__init__(spark, sf_dir)
        self.path, self.files_per_trigger = path, files_per_trigger

    def table(self, name: str) -> DataFrame:
        return T.open_stream(self.spark, self.path, files_per_trigger=self.files_per_trigger)


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def instant(c: str) -> Column:
    """Wall-clock column → instant, read as UTC whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch(), F.col(c)))


def wall_clock(c: str) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.col(c)), epoch()).alias(c)


def _run(fx: Fixtures, df: DataFrame, name: str) -> DataFrame:
    out, checkpoint = scratch_dir(fx.spark, name), scratch_dir(fx.spark, f"{name}-checkpoint")
    T.run_available(df, out, checkpoint)
    d = fx.spark.read.schema(df.schema).parquet(out)
    return d.select(*[wall_clock(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema.fields])


def _calls(fx: Fixtures, repeats: bool = False) -> DataFrame:
    e = StreamFixtures(fx.spark, fx.dir, *_arrived(fx, _by_time(fx), "calls", repeats)).table("events")
    return e.select(instant("ts").alias("ts"), "again", "user_id", F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), (F.col("event_type") != "error").alias("ok"), "event_id", "value")


@query("st1_first_answers")
def _(fx):
    """Of an answer and its repetition the first one wins."""
    answer = F.when(F.col("again"), F.lit("again")).otherwise(F.concat(F.lit("first "), F.floor("value")))
    log = _calls(fx, repeats=True).select("ts", "model", F.concat(F.lit("q"), "event_id").alias("uid"), answer.alias("answer"))
    return _run(fx, T.first_answers(log, "90 days"), "st1").filter("uid <> 'q-1'").select("model", "uid", "answer")


def _answers(fx: Fixtures) -> DataFrame:
    answers = F.array(*[F.lit(x) for x in ('{"answer": "holding"}', '{"answer": "dropped"}', "no idea", "__ERR__: 500")])
    return _calls(fx).select(
        "ts", "model", F.get(answers, (F.col("event_id") % 5 % 4).cast("int")).alias("raw"), F.lit("").alias("pred"), "ok", F.lit(None).cast("string").alias("error"),
        F.concat(F.lit("E_v12.env"), F.floor(F.col("event_id") / 64) % 2, F.lit(".g"), F.floor(F.col("event_id") / 64), F.lit(".e"), F.col("event_id")).alias("uid"),
    )


def _gold(fx: Fixtures) -> DataFrame:
    """Gold of the exam; every ninth row never gets any."""
    return fx("exam_e").filter("item_no % 9 <> 4").select("uid", "item_no", "task", F.col("answer").alias("gold"))


def _accuracy(fx: Fixtures) -> DataFrame:
    return _run(fx, T.running_accuracy(_answers(fx), _gold(fx).drop("item_no"), "1 day", "1 hour"), "st2")


@query("st2_totals_with_late_gold")
def _(fx):
    """While the log comes in, a third of the gold is not there yet."""
    gold = _gold(fx)
    table = T.RunningTotals(fx.spark, scratch_dir(fx.spark, "st2-totals"))
    table.follow(_answers(fx).filter("uid NOT LIKE '%.e-1'"), gold.filter("item_no % 3 <> 1"), scratch_dir(fx.spark, "st2-totals-checkpoint"))
    return table.totals(gold)


@query("st2_running_accuracy")
def _(fx):
    return _accuracy(fx)


@query("st2_accuracy_so_far")
def _(fx):
    return T.accuracy_so_far(_accuracy(fx))


@query("st3_throughput_tumbling")
def _(fx):
    return _run(fx, T.throughput(_calls(fx), F.window("ts", "1 hour"), "2 hours"), "st3t")


@query("st3_throughput_sliding")
def _(fx):
    return _run(fx, T.throughput(_calls(fx), F.window("ts", "1 hour", "15 minutes"), "2 hours"), "st3s")


@query("st4_sessions")
def _(fx):
    return _run(fx, T.sessions(_calls(fx), "12 hours", "1 hour", "user_id"), "st4")


@query("st5_event_tracker")
def _(fx):
    """Steps come by time, some of them a part late and after their successors."""
    e = StreamFixtures(fx.spark, fx.dir, *_arrived(fx, _by_time(fx), "steps"))
    steps = e("timed_steps").withColumn("ts", instant("ts"))
    with T.state_in_rocks(fx.spark):
        return _run(fx, T.track_events(steps, "1 hour"), "st5").filter("t >= 0")
