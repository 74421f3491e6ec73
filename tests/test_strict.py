"""Readers that refuse what a strict parser refuses, scenes in the scorer, and calls that go wrong."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from verdikt.functions import parse as P
from verdikt.operators import dims as D, gates as G, requests as R, sampling as K, scenes as C, scoring as S
from verdikt.session import scratch_dir

ANSWERS = {
    '{"answer": "x"}': ("x", "strict"),
    "{'answer': 'x'}": (None, "fail"),
    '{"answer": "a\nb"}': (None, "fail"),
    '{"answer": "a", "answer": "b"}': ("b", "strict"),
    '{"answer": 3}': ("3", "strict"),
    '{"answer": null}': (None, "fail"),
    '{"answer": "x"} more': (None, "fail"),
    '{"answer": "x"}, {"answer": "y"}': (None, "fail"),
    '{"answer": "x",}': (None, "fail"),
    '{"a": {"answer": "z"}, "answer": "q"}': ("q", "strict"),
    'so:\n{"answer": "l"}': ("l", "recoverable"),
    '```json\n{"answer": "f"}\n```': ("f", "recoverable"),
    "": (None, "fail"),
}


def test_json_answers(spark):
    df = spark.createDataFrame([(t,) for t in ANSWERS], "t string")
    assert {r.t: (r.j.value, r.j.mode) for r in df.select("t", P.json_answer("t").alias("j")).collect()} == ANSWERS


def read(spark, text):
    return C.read_scene(spark.createDataFrame([(text,)], "t string"), F.col("t")).first()


def test_scene_numbers_and_types(spark):
    r = read(
        spark,
        '{"agent": {"pos": [3.0, "4"], "dir": true, "carrying": {"type": "key", "color": 5}}, "front_cell": {"pos": [1, 2], "type": "door", "state": 2.0},'
        ' "objects": [{"type": "door", "pos": [1, 1], "color": "red", "state": true}, {"type": 3, "pos": [1, 2]}, {"type": "ball", "pos": [2, 2.5]}]}',
    )
    assert (r.p_pos.x, r.p_pos.y, r.p_dir, r.p_carry.type, r.p_carry.color, r.p_front.state) == (3, 4, 1, "key", None, "2")
    assert r.p_keys == ["door|1|1|red|1"]
    assert read(spark, '{"agent": {"carrying": 5}}').p_carry.type == C.UNKNOWN
    assert read(spark, '{"agent": {"carrying": null}}').p_carry is None and read(spark, '{"agent": {"carrying": null}}').p_has_carry
    assert read(spark, "{'agent': {}}").p_mode == "fail_json"


SCENE = '{"agent": {"pos": [1, 2], "dir": 0, "carrying": null}, "front_cell": {"pos": [2, 2], "type": "door", "state": 1}, "objects": []}'


def test_scenes_in_the_scorer(spark):
    gold = spark.createDataFrame([(u, "B", None, None if u == "nogold" else SCENE) for u in ("right", "missing", "failed", "torn", "nogold", "half")] + [("e", "E", "x", None)], "uid string, task string, gold string, answer_json string")
    said = [("right", SCENE, True), ("failed", "!!err 429", True), ("torn", "{", True), ("nogold", SCENE, True), ("half", '{"objects": []}', True), ("e", '{"answer": "x"}', True)]
    log = spark.createDataFrame([(u, "m", 0, raw, raw, ok, None) for u, raw, ok in said], "uid string, model string, ingest_seq long, raw string, pred string, ok boolean, error string")
    out = {r.uid: r for r in S.score(gold, log, ["m"], error_prefix="!!err").collect()}
    assert {u: r.failure for u, r in out.items()} == {
        "right": None, "missing": "missing_response", "failed": "api_error", "torn": "B_json_parse_error", "nogold": "B_missing_gold", "half": "B_missing_agent_pos", "e": None,
    }
    assert out["right"].score == pytest.approx(1.0) and out["right"].correct and out["e"].correct and 0 < out["half"].score < 1 and not out["half"].correct
    assert out["right"].b_components.agent_pos == 1.0 and out["e"].b_components is None


def test_error_texts_are_whole(spark):
    text = "x" * (1 << 20) + "end"
    r = R.to_response_rows(spark.createDataFrame([("u", P.ERROR_PREFIX + text)], "uid string, raw string"), "m").first()
    assert r.error == text and not r.ok
    assert D.with_exam_dims(spark.createDataFrame([("A.e.g.t7",)], "uid string")).first().t == 7


def test_shapes_are_told_apart(spark):
    rows = [("g", 0, [[[0, 0, 0]] * 10001]), ("g", 1, [[[0, 0, 0]] * 1] * 2)]
    df = spark.createDataFrame(rows, "group_id string, t int, encoding array<array<array<int>>>")
    assert G.encoding_report(df).first().n_shapes == 2


def test_shared_folder_is_needed_on_a_cluster():
    for master, works in (("local[4]", True), ("local", True), ("spark://host:7077", False), ("yarn", False), ("local-cluster[2,1,1024]", False)):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
        if works:
            assert scratch_dir(session, "x").startswith("/tmp/")
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                scratch_dir(session, "x")


def none_client():
    return lambda uids, prompts: [None if u == "a" else 5 if u == "b" else f"to {u}" for u in uids]


def no_client():
    raise RuntimeError("no key")


@pytest.mark.parametrize("batch", [1, 2, 100])
def test_clients_never_fail_a_task(spark, batch):
    q = spark.createDataFrame([(u, f"prompt {u}") for u in "abcde"], "uid string, prompt string")
    out = {r.uid: r for r in R.batch_infer(q, none_client, "m", batch=batch, shard=None).collect()}
    assert [out[u].ok for u in "abcde"] == [False, False, True, True, True] and out["c"].pred == "to c"
    assert out["a"].error and out["c"].latency_ms >= 0
    assert not any(r.ok for r in R.batch_infer(q, no_client, "m").collect())


@pytest.mark.parametrize("n", [K.LIMIT_PUSHED, K.LIMIT_PUSHED + 1])
def test_both_routes_of_top_per_key(spark, n):
    df = spark.range(2500).select(F.lit("k").alias("k"), F.col("id"))
    assert [r.id for r in K.top_per_key(df, ["k"], ["id"], n).orderBy("id").collect()] == list(range(n))
