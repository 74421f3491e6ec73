"""Queries: samples, ranked lists and hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import draw_key
from ..operators import candidates as H, sampling as K, sequence as Q
from ..operators.gates import VARIANTS
from ..session import landed
from .fixtures import Fixtures
from .registry import query

SEED = 7


def transition_states(fx: Fixtures) -> DataFrame:
    cols = ["x", "y", "dir", "front_type", "door_state", "visible"]
    t = Q.transitions(fx("steps").select("group_id", "env_task", "t", "action", *cols), cols)
    n = lambda c: F.col(f"next_{c}")
    c1 = F.concat_ws(",", n("x"), (n("y") + 1) % 7)
    c2 = F.concat_ws(",", (n("x") + 2) % 7, n("y"))
    t = t.select(
        "group_id", "env_task", "t", "action",
        F.struct(
            F.concat_ws(",", n("x"), n("y")).alias("pos"), n("dir").alias("dir"), F.concat_ws("/", n("front_type"), n("door_state")).alias("front"),
            F.array(c1, c2).alias("cells"), F.array(F.concat_ws("=", c1, n("visible")), F.concat_ws("=", c2, n("front_type"))).alias("keys"),
        ).alias("state"),
    )
    return t.withColumn("sig", F.md5(F.concat_ws("|", "state.pos", "state.dir", "state.front", F.array_join("state.keys", ";")).cast("binary")))


@query("k1_sample_groups")
def _(fx):
    return K.sample_groups(fx("steps").select("env_task", "group_id", "t"), 3, SEED)


@query("k2_first_complete_groups")
def _(fx):
    return K.first_complete_groups(fx("variant_steps"), 5, VARIANTS)


@query("k3_round_robin")
def _(fx):
    return K.round_robin_sample(fx("exam_c").select("uid", "env_task"), 100, SEED)


@query("k3_ordered")
def _(fx):
    return K.round_robin_sample(fx("exam_e").select("uid", "env_task", "item_no"), 75, SEED, ordered=F.col("item_no"))


ROLES = ["identity_short", "identity_medium", "identity_long", "status_early_holding", "status_mid_holding", "status_first_post_drop", "status_late_post_drop"]
EXTRA_ROLES = ["identity_long", "status_late_post_drop", "status_mid_holding", "identity_medium", "status_first_post_drop"]


@query("k4_quota_sample")
def _(fx):
    return K.quota_sample(fx("exam_e"), dict.fromkeys(ROLES, 5), EXTRA_ROLES, 36)


@query("k4_mandatory_audit")
def _(fx):
    return K.quota_sample(fx("exam_e"), dict.fromkeys(ROLES, 1), EXTRA_ROLES, 12, prefer_long=False)


@query("k4_focused_audit")
def _(fx):
    e = fx("exam_e").filter("env_task = 'env1'")
    return K.quota_sample(e, dict.fromkeys(ROLES, 3), [], 21, prefer_long=False, rank_once=True)


@query("k5_common_uid_sample")
def _(fx):
    r = fx("responses")
    uids = r.filter("model = 'm0'").select("uid").intersect(r.filter("model = 'm1'").select("uid"))
    return K.seeded_sample(uids, 200, SEED)


@query("k6_hard_negatives")
def _(fx):
    d = H.hard_negatives(landed(transition_states(fx), "transitions"), 2, SEED).filter("reason IS NULL")
    return d.select("group_id", "t", F.posexplode("negs").alias("rank", "n")).select(
        "group_id", "t", "rank", F.col("n.group_id").alias("neg_group"), F.col("n.t").alias("neg_t"), F.round("n.score", 6).alias("score"), "n.source"
    )


@query("k6_skip_reasons")
def _(fx):
    d = H.hard_negatives(landed(transition_states(fx), "transitions"), 2, SEED)
    return d.groupBy("env_task", F.coalesce("reason", F.lit("made")).alias("reason")).agg(F.count("*").alias("n"))


@query("j10_candidate_pool")
def _(fx):
    """The numbered states of each pool and the rows that stand for them."""
    p = H.numbered_pool(transition_states(fx))
    return p.select("env_task", "action", "idx", "sig", F.inline("reps"))


@query("k6_draws")
def _(fx):
    """The states that each question looks at, in its own order."""
    t = landed(transition_states(fx), "transitions")
    return H.draws(H.question_items(t, 2, SEED), H.numbered_pool(t), SEED)


@query("k7_permutation")
def _(fx):
    p = H.permuted_letters(fx("exam_a").select("uid"), SEED)
    return p.select("uid", F.array_join("candidate_order", ",").alias("candidate_order"), "correct_letter")


@query("k8_step_sample")
def _(fx):
    return K.sample_steps(fx("steps").select("group_id", "t"), 3, SEED)


@query("k9_ranked_sort")
def _(fx):
    e = fx("exam_d").select("uid", "subtask", "variant")
    e = e.withColumns({"family_rank": K.custom_rank("subtask", ["MACHINERY", "BUILDING"]), "variant_rank": K.custom_rank("variant", VARIANTS)})
    return e.orderBy("family_rank", "variant_rank", "uid")


@query("k10_head")
def _(fx):
    return fx("exam_e").select("uid", "item_no").orderBy("item_no").limit(20)


@query("k3_large_round_robin")
def _(fx):
    """A sample above the pushed rank limit: salted ranking first."""
    return K.round_robin_sample(fx("exam_e").select("uid", "env_task"), 1500, SEED)


@query("k1_draw_order")
def _(fx):
    return K.top_per_key(fx("orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], [draw_key(SEED, "o_orderkey")], 10)
