"""Invariants that hold whatever the data: totals, partitions of a set, resumed runs, edge cases of the scores."""

from pyspark.sql import functions as F

from verdikt.operators import joins as J, metrics as M, requests as R, scenes as C, scoring as S
from verdikt.plans.fixtures import MODELS
from verdikt.plans.requests import stub_client
from verdikt.plans.scores import gold, scored


def test_rollup_totals(fx):
    s = scored(fx)
    roll = S.score_rollup(s, [["model"], ["model", "task"]], ["overall", "task"])
    sums = {r["level"]: r["n"] for r in roll.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert sums["overall"] == sums["task"] == gold(fx).count() * len(MODELS)


def test_shards_partition_the_set(fx):
    g = fx("gold_rows").select("uid")
    parts = [J.shard(g, 5, k) for k in range(5)]
    assert sum(p.count() for p in parts) == g.count()
    assert all(p.count() > 0 for p in parts)


def test_resume_adds_nothing(fx):
    e = fx("exam_a").select("uid", "task", "env_task", "group_id", "prompt", "image")
    first = R.batch_infer(R.build_requests(e), stub_client, "stub")
    assert first.count() == e.count()
    assert R.batch_infer(R.build_requests(e), stub_client, "stub", log=first).count() == 0


def test_no_rows(spark, fx):
    row = S.score_stats(scored(fx).filter("model = 'nobody'")).first()
    assert (row["n"], row["acc"], row["missing_rate"]) == (0, 0.0, 0.0)


def test_zero_denominators(spark):
    d = spark.createDataFrame([("m", "orig", True), ("m", "rev", False)], "model string, temporal string, correct boolean")
    assert M.temporal_ratio(d).first()["les_t"] is None
    p = spark.createDataFrame([(1, 1), (0, 0)], "a int, b int")
    assert M.paired_delta(p, "a", "b").first()["mcnemar"] is None


def test_constant_judge(spark):
    rows = [(v, t, "Fail", v == "cf") for v in ("full", "cf") for t in ("orig", "rev")]
    d = spark.createDataFrame([("m", "g", *r) for r in rows], "model string, group_id string, variant string, temporal string, verdict string, correct boolean")
    assert M.degenerate(d).first()["degenerate"] == "all_fail"
    assert M.temporal_consistency(d, ["group_id", "variant"]).first()["jcr_pair"] == 1.0
    idr = M.intervention_rate(d, ["group_id", "temporal"]).first()
    assert (idr["n_pairs"], idr["idr"], idr["idr_cond"]) == (2, 0.0, None)


def test_scene_weights(spark):
    assert C.parse_weights("agent_pos=0.4, x, carrying=oops")["agent_pos"] == 0.4
    assert C.parse_weights(None) == C.WEIGHTS
    text = '{"agent": {"pos": [1, 2], "dir": 0, "carrying": null}, "front_cell": {"pos": [1, 3], "type": "door", "state": 2}, "objects": []}'
    d = C.read_scene(spark.createDataFrame([(text,)], "t string"), F.col("t"))
    d = d.withColumns({"g_pos": F.col("p_pos"), "g_dir": F.col("p_dir"), "g_carry": F.col("p_carry"), "g_front": F.col("p_front"), "g_keys": F.col("p_keys")})
    for w in (C.WEIGHTS, dict.fromkeys(C.WEIGHTS, 0.0)):
        r = C.score_scenes(d, w).first()
        assert round(r["score"], 9) == 1.0 and r["correct"] and r["failure"] is None
