"""View cells, corridor roles, drawn actions, usage sketches, term lists, score blocks and usage records on small tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdikt.operators import gates as G, requests as R, scenes as C, scoring as S, terms as N


def plain_seen(vx, vy, enc):
    if not (1 <= vx <= 7 and 1 <= vy <= 7) or enc is None:
        return False
    x, y = vx - 1, 7 - vy
    if x >= len(enc) or enc[x] is None or y >= len(enc[x]) or not enc[x][y]:
        return False
    kind, *rest = enc[x][y]
    return kind != 0 or (bool(rest) and rest[0] != 0)


def test_cells_of_an_encoding(spark):
    rng = random.Random(3)
    grids = [[[[rng.randrange(2), rng.randrange(2), 0] for _ in range(7)] for _ in range(7)] for _ in range(20)]
    grids[0][2] = None
    grids[1][3][4] = None
    grids[2][6][6], grids[2][6][5], grids[2][6][4] = [1], [0], []
    grids[3] = grids[3][:3]
    grids[4] = [c[:5] for c in grids[4]] + [[[1, 1, 1]] * 9] * 2
    grids += [None, [], [[]], [[[5, 5, 0]] * 7] * 7]
    heads = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "scene_id int, enc array<array<array<int>>>")
    places = spark.createDataFrame([(x, y) for x in range(-1, 10) for y in range(-1, 10)], "vx int, vy int")
    seen = heads.select("scene_id", C.seen_cells("enc").alias("cells")).crossJoin(places)
    got = {(r.scene_id, r.vx, r.vy) for r in seen.filter(C.cell_is_seen(F.col("cells"), F.col("vx"), F.col("vy"))).collect()}
    assert got == {(i, x, y) for i, g in enumerate(grids) for x in range(-1, 10) for y in range(-1, 10) if plain_seen(x, y, g)}


def test_objects_in_hidden_cells_are_left_out(spark):
    heads = spark.createDataFrame([(1, 3, 3, 0, 4, 3, [[[0, 0]] * 7] * 3 + [[[0, 0]] * 4 + [[2, 1]] + [[0, 0]] * 2] + [[[0, 0]] * 7] * 3)], "scene_id int, ax int, ay int, dir int, fx int, fy int, enc array<array<array<int>>>")
    # two cells ahead is view cell (4, 3), which the encoding keeps at (3, 4)
    objects = spark.createDataFrame([(1, "ball", 5, 3, "red", 0), (1, "ball", 6, 3, "red", 0)], "scene_id int, type string, px int, py int, color string, state int")
    assert [(r.vx, r.vy) for r in C.to_view(heads, objects, encoding="enc").collect()] == [(4, 3)]
    assert C.to_view(heads, objects).count() == 2


def test_roles_before_the_corridor(spark):
    rows = [("a", t, 1 if t < 4 else 5, True, t == 2) for t in range(6)]
    rows += [("many", t, 1, True, t == 0) for t in range(5)] + [("none", 0, 1, False, True), ("far", 0, 9, True, False), ("null", 0, None, True, None), ("null", 1, 1, None, None)]
    df = spark.createDataFrame(rows, "group_id string, t int, x int, v boolean, e boolean")
    got = {(r.group_id, r.t): r.role for r in G.corridor_steps(df, F.col("v"), F.col("e"), 5, 3).collect()}
    want = {("a", 0): "masked", ("a", 1): "masked", ("a", 2): "excluded", ("a", 3): "masked", ("none", 0): "excluded", ("many", 0): "excluded"}
    assert got == want | {("many", t): "void" for t in range(1, 5)}


def test_a_drawn_action_is_another_of_the_environment(spark):
    rng = random.Random(5)
    rows = [(f"u{i}", "hot" if i % 3 else f"env{i % 7}", f"free text {rng.randrange(400):04d}" if i % 11 else rng.choice([None, "", "  "]), "do it") for i in range(3000)]
    rows += [("one", "lonely", "wait", "wait"), ("two", None, "wait", "wait"), ("three", "nothing", None, "x")]
    df = spark.createDataFrame(rows, "uid string, env_task string, action string, prompt string").repartition(5)
    pools = {}
    for _, env, action, _ in rows:
        if action and action.strip() and env is not None:
            pools.setdefault(env, set()).add(action)
    out = {r.uid: r for r in R.action_shuffle(df, 7).collect()}
    assert len(out) == len(rows)
    import hashlib

    for uid, env, action, prompt in rows:
        others = sorted(pools.get(env, set()) - {action})
        want = others[int(hashlib.md5(f"7|{uid}".encode()).hexdigest()[:8], 16) % len(others)] if others else None
        assert out[uid].action == (want or action) and out[uid].original_action == (action if want else None)


def test_no_list_of_actions_is_collected(spark):
    df = spark.createDataFrame([("u", "e", "a", "p")], "uid string, env_task string, action string, prompt string")
    assert "collect" not in R.action_shuffle(df, 1)._jdf.queryExecution().optimizedPlan().toString()


def calls(spark, rows):
    return spark.createDataFrame(rows, "model string, day int, latency_ms double, ok boolean, prompt_tokens long, completion_tokens long")


def test_sketches_of_days_are_merged(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else "m", i % 40, rng.lognormvariate(5, 2), i % 9 > 0, 3, 4) for i in range(30000)]
    df = calls(spark, rows)
    parts = S.usage_parts(df, ["model"], "day")
    usage = S.usage_from_parts(parts, ["model"], (1, 50, 99))
    for r in S.rank_errors(df, usage, ["model"], (1, 50, 99)).collect():
        assert max(r.error_p1, r.error_p50, r.error_p99) <= 0.01
    # a part holds the same few kilobytes for a hundred and for ten thousand calls
    sizes = [r.n for r in S.usage_parts(df.withColumn("day", F.lit(0)), ["model"], "day").select(F.length("latency_sketch").alias("n")).collect()]
    assert max(sizes) < 20000
    exact = {r.model: r for r in S.usage_rollup(df, ["model"]).collect()}
    for r in usage.collect():
        assert (r.n_calls, r.total_tokens, r.ok_rate, r.max_latency) == (exact[r.model].n_calls, exact[r.model].total_tokens, exact[r.model].ok_rate, exact[r.model].max_latency)


def test_sketches_without_latencies(spark):
    df = calls(spark, [("a", 1, None, True, 1, 1), ("a", 2, float("nan"), None, None, 1), ("b", 1, None, True, 1, 1), ("b", 2, 8.0, False, 1, 1)])
    out = {r.model: r for r in S.usage_from_parts(S.usage_parts(df, ["model"], "day"), ["model"]).collect()}
    assert out["a"].latency_p50 is None and out["a"].n_calls == 2 and out["a"].ok_rate == 0.5
    assert out["b"].latency_p50 == 8.0 == out["b"].mean_latency and out["b"].ok_rate == 0.5
    assert S.usage_from_parts(S.usage_parts(calls(spark, []), ["model"], "day"), ["model"]).count() == 0


def test_ten_thousand_terms(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abCé ") for _ in range(rng.randint(1, 6)))
    terms = [word() for _ in range(10000)] + ["", "abab", "ab", "ab"]
    prompts = [word() * rng.randint(0, 6) + word() for _ in range(60)] + [None, "", "ab" * 200000]
    df = spark.createDataFrame(list(enumerate(prompts)), "id int, prompt string")
    got = {r.id: r for r in N.automaton_scan(df, terms).collect()}
    low = [t.lower() for t in terms]
    for i, p in enumerate(prompts):
        assert list(got[i].violations) == [t for t in low if t in (p or "").lower()] and got[i].blocked
    few = ["abab", "é", "cc"]
    same = N.automaton_scan(df, few).orderBy("id").collect()
    assert same == G.payload_scan(df, few).orderBy("id").collect()
    assert not any(r.blocked for r in N.automaton_scan(df, []).collect())


def test_term_lists_are_bounded(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "t string")
    assert N.term_list(df, "t") == ["a", "b"]
    with pytest.raises(ValueError, match="more than 1"):
        N.term_list(df, "t", 1)
    with pytest.raises(ValueError, match="letters"):
        N.automaton_scan(df, ["x" * (N.MOST_LETTERS + 1)], "t")


def test_score_block(spark):
    rows = [("m", "strict", None, 1.0, True), ("m", None, "api_error", 0.0, False), ("m", "strict", "E_wrong", 0.0, False), ("m", "fail", "missing_response", 0.0, False)]
    df = spark.createDataFrame(rows, "model string, parse_mode string, failure string, score double, correct boolean")
    r = S.score_block(df, ["model"]).first()
    assert r.parse_modes == {"strict": 2, "fail": 2} and r.failures == {"api_error": 1, "E_wrong": 1, "missing_response": 1}
    assert (r.n, r.mean_score, r.acc, r.api_error_rate, r.missing_rate) == (4, 0.25, 0.25, 0.25, 0.25)
    zero = S.score_block(df.limit(0)).first()
    assert zero.asDict() == {"n": 0, "mean_score": 0.0, "acc": 0.0, "api_error_rate": 0.0, "missing_rate": 0.0, "parse_modes": {}, "failures": {}}


def test_files_of_a_model(spark):
    gold = spark.createDataFrame([("a",), ("b",)], "uid string")
    log = spark.createDataFrame([("a", "m", "f1"), ("a", "m", "f2"), ("x", "m", "f2")], "uid string, model string, file string")
    out = {r.model: r for r in S.coverage(gold, log, ["m", "n"], "file").collect()}
    assert (out["m"].n_files, out["m"].n_missing, out["m"].n_extra, out["n"].n_files) == (2, 1, 1, 0)


def mixed_client():
    replies = {
        "a": {"text": "yes", "finish_reason": "stop", "usage": {"prompt_tokens": 5, "completion_tokens": 2}},
        "b": {"text": None, "finish_reason": "length", "usage": {"prompt_tokens": 7, "completion_tokens": 0, "total_tokens": 9}},
        "c": "plain",
        "d": {"text": "no", "usage": None},
        "e": ["no reply"],
        "f": {"text": "x", "usage": {"prompt_tokens": "many", "completion_tokens": float("nan")}},
    }
    return lambda uids, prompts: [replies[u] for u in uids]


@pytest.mark.parametrize("batch", [1, 100])
def test_records_hold_the_usage(spark, batch):
    q = spark.createDataFrame([(u, f"prompt {u}") for u in "abcdef"] + [("g", "reward")], "uid string, prompt string")
    out = {r.uid: r for r in R.batch_infer(q, mixed_client, "m", terms=["reward"], batch=batch, protocol="chat").collect()}
    assert (out["a"].prompt_tokens, out["a"].completion_tokens, out["a"].total_tokens, out["a"].finish_reason, out["a"].ok) == (5, 2, 7, "stop", True)
    assert not out["b"].ok and out["b"].total_tokens == 9 and out["b"].finish_reason == "length" and "empty answer" in out["b"].error
    assert out["c"].pred == "plain" and out["c"].prompt_tokens is None and out["d"].ok and out["d"].total_tokens is None
    assert not out["e"].ok and out["f"].ok and out["f"].prompt_tokens is None and not out["g"].ok and out["g"].total_tokens is None
    assert {r.protocol for r in out.values()} == {"chat"}


def test_no_rows_give_no_records():
    empty = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("uid", object), ("prompt", object), ("blocked", bool), ("error", object), ("finish_reason", object))})
    (out,) = R._call_batches(iter([empty]), mixed_client, "!", 4)
    assert not len(out) and list(out.columns)[-3:] == R.USAGE
