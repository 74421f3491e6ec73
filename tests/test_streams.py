"""Streams that arrive out of order, in several runs, and again."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from verdikt.streaming import streams as T

T0 = datetime(2024, 1, 1)


def events(steps):
    """Events of one group's steps in order, written out."""
    out, carry, held = [], None, set()
    for t, now in sorted(steps, key=lambda s: s[0]):
        if now is not None and carry is None:
            out.append((t, "reacquire" if now in held else "pickup", now))
            held.add(now)
        elif now is None and carry is not None:
            out.append((t, "drop", carry))
            held.add(carry)
        carry = now
    return out


def test_steps_in_any_order_over_several_runs(spark, tmp_path):
    rng = random.Random(9)
    schema = "group_id string, t bigint, carry string, ts timestamp"
    rows = [(f"g{g}", t, rng.choice([None, None, "a", "b"]), T0 + timedelta(minutes=10 * t + g)) for g in range(6) for t in range(40)]
    # up to half an hour late: neighbours change places, also across batches
    arriving = sorted(rows, key=lambda r: r[3] + timedelta(minutes=rng.randrange(30)))
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    with T.state_in_rocks(spark):
        for k in range(0, len(arriving), 40):
            part = arriving[k : k + 40] + ([("end", -1, None, T0 + timedelta(days=90))] if k + 40 >= len(arriving) else [])
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            T.run_available(T.track_events(T.open_stream(spark, src), "1 hour"), out, check)  # each run goes on from the last
    got = spark.read.schema(T.EVENT_SCHEMA).parquet(out).collect()
    for g in range(6):
        assert sorted((r.t, r.kind, r.label) for r in got if r.group_id == f"g{g}") == events([(t, c) for i, t, c, _ in rows if i == f"g{g}"])


@pytest.fixture()
def log(spark):
    rows = [("u1", "m", "Success", "", True, None), ("u2", "m", "Fail", "", True, None), ("u3", "m", "no idea", "", True, None), ("u4", "m", "Success", "", False, "boom"), ("nowhere", "m", "Success", "", True, None)]
    return spark.createDataFrame(rows, "uid string, model string, raw string, pred string, ok boolean, error string")


def counts(table, gold):
    return {(r.model, r.task): (r.n, r.n_correct, r.n_error) for r in table.totals(gold).collect()}


def test_totals_after_every_batch_again_and_with_late_gold(spark, log, tmp_path):
    gold = spark.createDataFrame([("u1", "C", "Success"), ("u2", "C", "Success"), ("u3", "C", "Fail"), ("u4", "C", "Success")], "uid string, task string, gold string")
    some = gold.filter("uid <> 'u1'")
    table = T.RunningTotals(spark, str(tmp_path / "totals"))
    assert counts(table, gold) == {}
    read = T.read_log(log)
    table.add(read, 0, some)
    want = {("m", "C"): (3, 1, 1), ("m", None): (2, 0, 0)}
    assert counts(table, some) == want
    table.add(read, 0, some)  # the batch runs again
    assert counts(table, some) == want
    assert counts(table, gold) == {("m", "C"): (4, 2, 1), ("m", None): (1, 0, 0)}
    table.add(read.filter("uid = 'u1'"), 1, gold)
    assert counts(table, gold) == {("m", "C"): (5, 3, 1), ("m", None): (1, 0, 0)}


def test_totals_follow_a_stream(spark, log, tmp_path):
    src = str(tmp_path / "src")
    gold = spark.createDataFrame([("u1", "C", "Success"), ("u2", "C", "Success")], "uid string, task string, gold string")
    table = T.RunningTotals(spark, str(tmp_path / "totals"))
    for uid, want in (("u1", (1, 1, 0)), ("u2", (2, 1, 0))):
        log.filter(f"uid = '{uid}'").coalesce(1).write.mode("append").parquet(src)
        table.follow(T.open_stream(spark, src), gold, str(tmp_path / "check"))
        assert counts(table, gold)[("m", "C")] == want


class Kept:
    """A list or value of the state that counts the calls into it."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def _call(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def appendValue(self, row):
        self._call([*self.rows, row])

    def put(self, rows):
        self._call(list(rows))

    def update(self, row):
        self._call([row])

    def clear(self):
        self._call([])


class Handle:
    def __init__(self):
        self.waiting, self.last, self.timers = Kept(), Kept(), []
        self.waiting.get = lambda: iter(self.waiting.rows)
        self.last.get = lambda: self.last.rows[0] if self.last.rows else None
        self.getListState, self.getValueState = lambda *_: self.waiting, lambda *_: self.last
        self.registerTimer = self.timers.append


class Clock:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_calls_into_the_state_do_not_grow_with_the_groups():
    ms = lambda t: int(t.timestamp() * 1000)
    at = lambda m: T0 + timedelta(minutes=m)
    steps = [(f"g{g}", t, "a" if t % 3 == 1 else None, at(t)) for t in range(9) for g in range(500)]
    random.Random(3).shuffle(steps)
    handle, tracker = Handle(), T.EventTracker(86_400_000)
    tracker.init(handle)
    got = []
    for part in (steps[:3000], steps[3000:]):
        frame = pd.DataFrame(part, columns=["group_id", "t", "carry", "ts"])
        got += list(tracker.handleInputRows((0,), iter([frame]), None))
    offset = int(pd.Timestamp(T0).value // 10**6) - ms(T0)  # the frames have no zone
    for m in (4, 20):
        now = Clock(ms(at(m)) + offset)
        got += list(tracker.handleExpiredTimer((0,), now, now))
    assert handle.waiting.calls + handle.last.calls <= 6 and len(handle.timers) <= 8
    rows = pd.concat(got)
    want = [(f"g{g}", *e) for g in range(500) for e in events([(t, "a" if t % 3 == 1 else None) for t in range(9)])]
    assert sorted(rows.itertuples(index=False, name=None)) == sorted(want)
    # a day later nothing is kept any more
    now = Clock(ms(at(20)) + offset + 3 * 86_400_000)
    assert list(tracker.handleExpiredTimer((0,), now, now)) == [] and handle.last.rows == [] and handle.waiting.rows == []


def test_groups_of_one_bucket_keep_apart(spark, tmp_path):
    rows = [(g, t, c, T0 + timedelta(minutes=t)) for g in ("a", "b", None) for t, c in enumerate([None, "x", None, "x" if g == "a" else "y", None])]
    rows.append(("end", -1, None, T0 + timedelta(days=90)))
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.createDataFrame(rows, "group_id string, t bigint, carry string, ts timestamp").coalesce(1).write.parquet(src)
    with T.state_in_rocks(spark):
        T.run_available(T.track_events(T.open_stream(spark, src), "1 hour", buckets=1), out, check)
    got = spark.read.schema(T.EVENT_SCHEMA).parquet(out).collect()
    for g in ("a", "b", None):
        assert sorted((r.t, r.kind, r.label) for r in got if r.group_id == g) == events([(t, c) for i, t, c, _ in rows if i == g])
