"""Sequence operators on one hot group cut into small blocks, against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from verdikt.operators import sequence as Q
from verdikt.operators.joins import first_per_key, last_per_key, spread_join
from verdikt.operators.sampling import greedy_picks, quota_sample, top_per_key
from verdikt.plans.fixtures import Fixtures
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def hot():
    rng = random.Random(5)
    rows = [("hot", t, rng.choice([None, "a", "b", "c"])) for t in range(900)]
    return rows + [(f"g{i}", t, rng.choice([None, "a"])) for i in range(20) for t in range(rng.randint(1, 12))]


def events_by_scan(rows):
    out, groups = [], {}
    for g, t, c in sorted(rows, key=lambda r: (r[0], r[1])):
        carry, held = groups.setdefault(g, [None, set()])
        if c is not None and carry is None:
            out.append((g, t, "reacquire" if c in held else "pickup", c))
            held.add(c)
        elif c is None and carry is not None:
            out.append((g, t, "drop", carry))
            held.add(carry)
        groups[g][0] = c
    return sorted(out)


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_carry_events(spark, hot, block):
    d = spark.createDataFrame(hot, "group_id string, t bigint, carry string")
    got = sorted((r.group_id, r.t, r.kind, r.label) for r in Q.carry_events(d, block=block).collect())
    assert got == events_by_scan(hot)


@pytest.mark.parametrize("offset", [-1, 1])
def test_neighbour(spark, hot, offset):
    d = spark.createDataFrame(hot, "group_id string, t bigint, carry string")
    at = {(g, t): c for g, t, c in hot}
    got = {(r.group_id, r.t): r.other for r in Q.with_neighbour(d, {"other": "carry"}, offset, block=7).collect()}
    assert got == {(g, t): at.get((g, t + offset)) for g, t, _ in hot}


@pytest.mark.parametrize("block", [5, 4096])
def test_status_as_of(spark, hot, block):
    d = spark.createDataFrame(hot, "group_id string, t bigint, carry string")
    ev = events_by_scan(hot)
    points = [("hot", lab, q) for lab in "abc" for q in range(0, 900, 13)] + [(f"g{i}", "a", 5) for i in range(20)]
    q = spark.createDataFrame(points, "group_id string, label string, query_step bigint")
    got = {(r.group_id, r.label, r.query_step): r.status for r in Q.status_as_of(Q.carry_events(d), q, block=block).collect()}

    def last(g, lab, kind, t):
        return max((e[1] for e in ev if e[0] == g and e[3] == lab and e[2] == kind and e[1] <= t), default=None)

    for g, lab, t in points:
        p, dr, re = (last(g, lab, k, t) for k in ("pickup", "drop", "reacquire"))
        if not any(e[0] == g and e[3] == lab and e[2] == "pickup" for e in ev):
            want = "dropped"
        elif re is not None:
            want = "reacquired_and_holding"
        else:
            want = "holding" if p is not None and (dr is None or dr < p) else "dropped"
        assert got[(g, lab, t)] == want


def test_number_rows(spark):
    d = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), "id")
    rows = Q.number_rows(d, ["k"], ["id"], F.floor(F.col("id") / 17)).collect()
    for k in "ab":
        ids = sorted(r.id for r in rows if r.k == k)
        assert {r.id: r.idx for r in rows if r.k == k} == {x: i for i, x in enumerate(ids)}


def test_first_and_last_of_a_hot_key(spark):
    d = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("uid"), (F.col("id") * 7919 % 5000).alias("seq"), F.col("id").alias("v"))
    f = first_per_key(d, ["uid"], "seq").filter("uid = 0").first()
    lst = last_per_key(d, ["uid"], "seq").filter("uid = 0").first()
    seqs = [(i * 7919 % 5000, i) for i in range(4000)]
    assert (f.seq, f.v) == min(seqs) and (lst.seq, lst.v) == max(seqs) and f.n_copies == 4000


def test_spread_join_equals_join(spark):
    big = spark.range(3000).select((F.col("id") % 2 * F.col("id")).alias("k"), "id")
    small = spark.range(0, 3000, 5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        a = sorted(map(tuple, spread_join(big, small, ["k"], F.col("id"), how).select("k", "id", "w").fillna(-1).collect()))
        assert a == sorted(map(tuple, big.join(small, ["k"], how).select("k", "id", "w").fillna(-1).collect()))


def test_large_top_per_key(spark):
    d = spark.range(9000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 9001).alias("o"))
    got = sorted(r.o for r in top_per_key(d, ["k"], ["o"], 1200).collect())
    assert got == sorted(i * 7919 % 9001 for i in range(9000))[:1200]


ROLES = ["identity_short", "identity_medium", "identity_long", "status_early_holding", "status_mid_holding", "status_first_post_drop", "status_late_post_drop"]


@pytest.mark.parametrize(
    "targets,extras,total,prefer,once",
    [
        (dict.fromkeys(ROLES, 5), ["identity_long", "status_mid_holding"], 36, True, False),
        (dict.fromkeys(ROLES, 1), ["identity_long", "status_mid_holding"], 12, False, False),
        (dict.fromkeys(ROLES, 3), [], 21, False, True),
        ({"identity_short": 40, "none_such": 2}, ["identity_short"], 60, True, False),
    ],
)
def test_quota_sample_equals_unpruned_greedy(spark, targets, extras, total, prefer, once):
    exam = Fixtures(spark, SF_DIR)("exam_e").select(
        "env_task", "sampling_role", F.concat(F.lit("h"), F.col("item_no") % 9).alias("group_id"), "uid", "horizon_bucket"
    )
    got = quota_sample(exam, targets, extras, total, prefer, once).toPandas().sort_values(["env_task", "pick", "sampling_role"])
    full = exam.toPandas()
    full["short"] = (full["horizon_bucket"] != "long").astype(int) if prefer else 0
    for env, pdf in full.groupby("env_task"):
        want = greedy_picks(pdf, list(targets.items()), extras, total, once).sort_values(["env_task", "pick", "sampling_role"])
        mine = got[got["env_task"] == env]
        assert mine.fillna("").values.tolist() == want.fillna("").values.tolist()
        picked = mine[mine["pick"] > 0]
        assert picked["uid"].is_unique and len(picked) <= total


def test_questions_of_one_pool_draw_their_own_states(fx):
    from verdikt.operators import candidates as H
    from verdikt.plans.samples import transition_states

    t = transition_states(fx)
    rows = H.draws(H.question_items(t, 2, 7), H.numbered_pool(t), 7).join(t.select("group_id", "t", "env_task", "action"), ["group_id", "t"]).collect()
    by_pool = {}
    for r in rows:
        by_pool.setdefault((r.env_task, r.action), {}).setdefault((r.group_id, r.t), []).append(r.sig)
    large = [q for q in by_pool.values() if len(q) > 2]
    assert large and any(len({frozenset(s) for s in q.values()}) > 1 for q in large)
    assert all(len(set(s)) == len(s) <= H.POOL_LOOK for q in by_pool.values() for s in q.values())


def test_answers_are_read_once_and_after_the_join(fx):
    """Text reading stays above the join with gold, and a filter on what it gives does not repeat it."""
    from verdikt.operators import scoring as S
    from verdikt.plans.scores import scored

    plan = S.histogram(scored(fx), "failure", ["model", "task"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert plan.index("regexp_extract_all") < plan.index("Join")


def test_first_and_last_answers_are_joined_to_gold_once_for_all_models(spark):
    """Same rows as the join per model, with repeated gold, foreign uids and models, and a model without answers."""
    from verdikt.operators.joins import gold_left_join, picked_left_join

    gold = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), (None, 5)], "uid string, item int")
    log = [("a", "m0", 3, "x"), ("a", "m0", 1, "y"), ("a", "m1", 2, None), ("b", "m1", 5, "z"), ("b", "m9", 1, "w"), ("q", "m0", 1, "v"), ("b", None, 1, "u"), (None, "m0", 1, "t")]
    log = spark.createDataFrame(log, "uid string, model string, ingest_seq bigint, raw string")
    for keep, pick in (("first", first_per_key), ("last", last_per_key)):
        plain = gold_left_join(gold, pick(log, ["uid", "model"], "ingest_seq"), ["m0", "m1", "m2"])
        out = picked_left_join(gold, log, ["m0", "m1", "m2"], "ingest_seq", keep)
        assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
