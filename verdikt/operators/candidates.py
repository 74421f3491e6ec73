"""Hard negatives for next-state questions.

A question shows the true next state of a step and three wrong ones.  Up to two come from the item's own
trajectory (most similar first); the rest come from steps of other groups in the same environment with the
same action, of which ten different states are looked at, drawn anew for each question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import draw_key, stable_int
from .joins import block_join, spread_join
from .sampling import top_per_key
from .sequence import number_rows

# Fixed values.
MOVE_ACTIONS = [0, 1, 2]
OWN_LIMIT, POOL_LOOK, WANTED = 2, 10, 3
WRONG_PLACE = 100.0

# Steps of the draws: primes above any pool size, so that every one visits all states of a pool.
DRAW_STEPS = [2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497]

STATE = ["pos", "dir", "front", "cells", "keys"]


def similarity_penalty(action: Column, a: Column, b: Column) -> Column:
    """How much less alike two states are: 0 is the hardest negative.

    ``cells`` are object positions, ``keys`` the same positions with what is there.  Each cell that is
    filled differently, or in one state only, adds a half.
    """
    here = a["pos"] == b["pos"]
    moved = F.when(here, 0.0).otherwise(10.0)
    turned = F.when(a["dir"].eqNullSafe(b["dir"]), 0.0).otherwise(2.0)
    front = F.when(a["front"].eqNullSafe(b["front"]), 0.0).otherwise(1.0)
    common = F.size(F.array_intersect(a["cells"], b["cells"]))
    same = F.size(F.array_intersect(a["keys"], b["keys"]))
    objects = (F.size(a["cells"]) + F.size(b["cells"]) - common - same) * 0.5
    return F.when(~action.isin(MOVE_ACTIONS) & ~here, WRONG_PLACE).otherwise(moved + turned + front + objects)


def numbered_pool(trans: DataFrame) -> DataFrame:
    """The different states of each (environment, action) pool with a number from 0 in ``idx``.

    ``reps`` are the first rows that show the state, by group and t, from up to two groups: enough to find one that is
    not the question's own.
    """
    one = trans.groupBy("env_task", "action", "sig", "group_id").agg(F.min("t").alias("t"))
    two = top_per_key(one, ["env_task", "action", "sig"], ["group_id"], 2, "_k")
    states = two.groupBy("env_task", "action", "sig").agg(F.sort_array(F.collect_list(F.struct("group_id", "t"))).alias("reps"))
    # signatures are md5 texts: their first digits cut the order into even ranges
    return number_rows(states, ["env_task", "action"], ["sig"], F.substring("sig", 1, 3))


def draws(questions: DataFrame, pool: DataFrame, seed: object) -> DataFrame:
    """The first POOL_LOOK usable states of each question: group_id, t, draw, sig and the row that shows it.

    Question ``i``-th looks at position ``(step * i + start) mod n`` with its own step and start.  Refused are only its
    own state and states of its own group alone, so POOL_LOOK positions more than those are always enough.
    """
    sizes = pool.groupBy("env_task", "action").agg(F.count("*").alias("n_states"))
    alone = pool.filter(F.size("reps") == 1).groupBy("env_task", "action", F.col("reps")[0]["group_id"].alias("group_id")).agg(F.count("*").alias("n_alone"))
    number = lambda tag: stable_int(F.concat_ws("|", F.lit(f"{seed}|{tag}"), "group_id", "t"))
    q = questions.select("env_task", "action", "group_id", "t", F.col("sig").alias("true_sig"))
    q = spread_join(q, sizes, ["env_task", "action"], F.struct("group_id", "t")).join(alone, ["env_task", "action", "group_id"], "left")
    need = F.least(F.col("n_states"), F.coalesce("n_alone", F.lit(0)) + POOL_LOOK + 1)
    step = F.get(F.array(*[F.lit(x) for x in DRAW_STEPS]), (number("step") % len(DRAW_STEPS)).cast("int"))
    q = q.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), need - 1)))
    q = q.withColumn("idx", (F.pmod(step, F.col("n_states")) * F.col("draw") + number("start")) % F.col("n_states"))
    met = q.join(pool, ["env_task", "action", "idx"]).filter("sig <> true_sig")
    met = met.withColumn("rep", F.get(F.filter("reps", lambda r: r["group_id"] != F.col("group_id")), F.lit(0))).filter("rep IS NOT NULL")
    looked = top_per_key(met, ["group_id", "t"], ["draw"], POOL_LOOK, "_k")
    return looked.select("group_id", "t", "draw", "sig", F.col("rep.group_id").alias("neg_group"), F.col("rep.t").alias("neg_t"))


def question_items(trans: DataFrame, per_trajectory: int, seed: object) -> DataFrame:
    """The steps that become questions: a few of each trajectory, by seed."""
    return top_per_key(trans, ["group_id"], [draw_key(f"{seed}|A", "group_id", "t"), "t"], per_trajectory, "_draw").drop("_draw")


def hard_negatives(trans: DataFrame, per_trajectory: int, seed: object) -> DataFrame:
    """Items with ``negs`` (three structs, hardest own ones first) or a ``reason`` why there are none.

    ``trans`` has group_id, env_task, t, action, sig and ``state``, the struct of STATE after the step.
    """
    items = question_items(trans, per_trajectory, seed)
    sizes = trans.groupBy("env_task", "action").agg(F.count("*").alias("pool_size"))

    # own trajectory: each step meets the few items of its group; best row per state, then the best two
    last = trans.groupBy("group_id").agg(F.max("t").alias("last_t"))
    q = items.select("group_id", F.col("t").alias("item_t"), F.col("sig").alias("true_sig"), F.col("state").alias("true_state"), F.col("action").alias("item_action"))
    own = block_join(trans.select("group_id", "t", "sig", "state"), q.join(last, "group_id"), ["group_id"], "last_t").filter("t <> item_t AND sig <> true_sig")
    own = own.select("group_id", "item_t", "t", "sig", similarity_penalty(F.col("item_action"), F.col("true_state"), F.col("state")).alias("score"))
    own = own.groupBy("group_id", "item_t", "sig").agg(F.min(F.struct("score", "t")).alias("b")).select("group_id", "item_t", "sig", "b.*")
    own = top_per_key(own, ["group_id", "item_t"], ["score", "t"], OWN_LIMIT, "_k")
    own = own.groupBy("group_id", "item_t").agg(
        F.array_sort(F.collect_list(F.struct("score", "t", "group_id", "sig", F.lit("own").alias("source")))).alias("own")
    )

    # other groups: the states of the drawn rows are fetched at the end
    seen = draws(items, numbered_pool(trans), seed)
    shown = trans.select(F.col("group_id").alias("neg_group"), F.col("t").alias("neg_t"), F.col("state").alias("neg_state"))
    mine = items.select("group_id", "t", "action", "state")
    fill = seen.join(shown, ["neg_group", "neg_t"]).join(mine, ["group_id", "t"])
    score = similarity_penalty(F.col("action"), F.col("state"), F.col("neg_state"))
    fill = fill.select("group_id", "t", F.struct(score.alias("score"), "draw", F.col("neg_t").alias("t"), F.col("neg_group").alias("group_id"), "sig").alias("f"))
    fill = fill.groupBy("group_id", "t").agg(F.sort_array(F.collect_list("f")).alias("fill"))

    d = items.join(own.withColumnRenamed("item_t", "t"), ["group_id", "t"], "left").join(fill, ["group_id", "t"], "left")
    d = spread_join(d, sizes, ["env_task", "action"], F.struct("group_id", "t"))
    empty = F.array().cast("array<struct<score:double,t:bigint,group_id:string,sig:string,source:string>>")
    d = d.withColumn("own", F.coalesce("own", empty))
    other = F.filter("fill", lambda c: ~F.exists("own", lambda o: o["sig"] == c["sig"]))
    rest = F.transform(
        F.slice(other, F.lit(1), WANTED - F.size("own")),
        lambda c: F.struct(c["score"].alias("score"), c["t"].alias("t"), c["group_id"].alias("group_id"), c["sig"].alias("sig"), F.lit("pool").alias("source")),
    )
    d = d.withColumn("negs", F.concat("own", F.coalesce(rest, empty)))
    reason = F.when(F.col("pool_size") < WANTED, F.lit("small_pool")).when(F.size("negs") < WANTED, F.lit("insufficient_negs"))
    return d.withColumn("reason", reason).drop("fill", "own")


def permuted_letters(df: DataFrame, seed: object, uid: str = "uid", n: int = 4) -> DataFrame:
    """Seeded order of the ``n`` candidates (number 0 is the right one) and the letter it ends up under."""
    order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(uid), i.cast("string")).cast("binary")).alias("k"), i.alias("i")),
        )
    )
    ids = F.transform(order, lambda s: s["i"])
    return df.withColumn("candidate_order", ids).withColumn(
        "correct_letter", F.substring(F.lit("ABCDEFGH"), F.array_position("candidate_order", F.lit(0)).cast("int"), F.lit(1))
    )
