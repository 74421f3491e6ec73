"""Answers that several judges share, scenes of any length, and packed files of bounded size."""

import json
import random

from pyspark.sql import functions as F

from verdikt.operators import joins as J, scenes as C, scoring as S
from verdikt.sources import jsonl as L, sinks

MODELS = ["m0", "m1", "m2"]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_shared_answers_are_one_row(spark):
    rng = random.Random(3)
    gold = spark.createDataFrame([(f"u{i}", i) for i in range(60)], "uid string, n int")
    log = [(f"u{rng.randrange(70)}", rng.choice([*MODELS, "other"]), rng.choice(["x", "y", None, ""]), k, rng.random() < 0.5) for k in range(400)]
    log = spark.createDataFrame(log, "uid string, model string, said string, seq long, ok boolean")
    for keep in ("first", "last"):
        want = J.picked_left_join(gold, log, MODELS, "seq", keep)
        shared = J.answers_left_join(gold, log, MODELS, "seq", "said", keep)
        assert rows_of(J.each_model(shared).select(want.columns)) == rows_of(want)
        said = {}
        for r in want.collect():
            said.setdefault(r.uid, set()).add(r.said)
        assert shared.count() == sum(map(len, said.values())) < want.count()


def test_scores_of_shared_scenes(spark):
    scene = lambda k: {"agent": {"pos": [1, k], "dir": 0, "carrying": None}, "front_cell": {"pos": [2, 1], "type": "door", "state": 1}, "objects": [{"type": "key", "pos": [k, 3], "color": "red"}]}
    gold = spark.createDataFrame([("b1", "B", None, json.dumps(scene(1))), ("b2", "B", None, json.dumps(scene(2))), ("b3", "B", None, None), ("c1", "C", "Fail", None)], "uid string, task string, gold string, answer_json string")
    log = [(u, m, 0, json.dumps(scene(1)) if u[0] == "b" else "failed", None, not (m == "m2" and u == "b1"), None) for u in ("b1", "b2", "b3", "c1") for m in MODELS if (u, m) != ("b2", "m1")]
    log = spark.createDataFrame(log, "uid string, model string, ingest_seq long, raw string, pred string, ok boolean, error string")
    got = {(r.uid, r.model): r for r in S.score(gold, log, MODELS).collect()}
    assert len(got) == 12
    assert {k: got[k].failure for k in got} == {(u, m): "missing_response" if (u, m) == ("b2", "m1") else "api_error" if (u, m) == ("b1", "m2") else "B_missing_gold" if u == "b3" else None for u, m in got}
    assert got["b1", "m0"].correct and not got["b2", "m0"].correct and got["b2", "m0"].score == got["b2", "m2"].score > 0 and got["c1", "m2"].correct


def test_scenes_with_short_and_long_lists(spark):
    """Lists that are read in compiled code and longer ones give the same keys."""
    rng = random.Random(5)
    pick = lambda: {"type": rng.choice(["door", " key ", "ball", None, "door\n"]), "pos": rng.choice([[1, 2], ["3", "04"], [1], [1, 2, 3], ["x", 1], [7.0, -12]]), "color": rng.choice(["red", " blue", None]), "state": rng.choice([1, "open ", None, "3", 0])}
    lists = [[pick() for _ in range(n)] for n in (0, 1, 2, 7, 8, 9, 12, 30) for _ in range(6)] + [None]

    def keys(objects):
        out = []
        for o in objects or []:
            at = [int(float(x)) if str(x) != "x" else None for x in o["pos"]]
            if o["type"] is None or len(at) != 2 or None in at:
                continue
            kind, color = o["type"].strip(), (o["color"] or "-").strip()
            state = str(o["state"]).strip() if kind == "door" and o["state"] is not None else "-"
            out.append("|".join([kind, str(at[0]), str(at[1]), color, state]))
        return list(dict.fromkeys(out))

    d = spark.createDataFrame([(i, json.dumps({"objects": o})) for i, o in enumerate(lists)], "i int, t string")
    for r in C.read_scene(d, F.col("t")).collect():
        assert r.p_keys == keys(lists[r.i]), lists[r.i]
        assert r.p_has_objects == (lists[r.i] is not None) and r.p_mode == "strict"


def test_packed_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 3)
    sinks.write_jsonl(spark.range(10).coalesce(1), str(tmp_path / "log"), compression="gzip")
    assert len(list((tmp_path / "log").glob("part-*.gz"))) == 4
    lines = L.read_shards(spark, str(tmp_path / "log"), "id long").collect()
    assert [r.id for r in sorted(lines, key=lambda r: (r.ingest.file, r.ingest.block, r.ingest.line))] == list(range(10))


def test_asked_columns_of_gold(spark, tmp_path):
    rows = [("u1", " a "), ("u2", "b"), ("", "x")]
    for name, r in (("task_a_exam.jsonl", rows), ("task_c_exam.jsonl", [("u2", "c")])):
        spark.createDataFrame(r, "uid string, answer string").write.json(str(tmp_path / "exam" / name))
    whole, part = L.load_gold(spark, str(tmp_path / "exam")), L.load_gold(spark, str(tmp_path / "exam"), columns=["answer"])
    assert rows_of(part.select("uid", "task", "answer")) == rows_of(whole.select("uid", "task", "answer")) and part.count() == 2
    assert "prompt" not in part.columns and "variant" not in part.columns
