"""Queries: step sequences, checkpoints, key frames and trajectory gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import gates as G, joins as J, sequence as Q
from ..session import landed
from .fixtures import Fixtures
from .registry import query

STATE = ["x", "y", "dir", "carry", "front_type", "door_state", "visible"]


def trajectories(fx: Fixtures) -> DataFrame:
    """One row per group and variant with step arrays; an episode has at most 64 steps."""
    step = F.struct("t", "action", F.struct("x", "y", "dir").alias("state"), "visible")
    arrays = (
        fx("variant_steps")
        .groupBy("group_id", "env_task", "variant", "grp")
        .agg(F.array_sort(F.collect_list(step)).alias("_s"))
    )
    heads = fx("headers").drop("env_task", "grp")
    n = F.size("_s")
    cf_goal = F.when(F.col("variant") == "cf", F.struct((F.col("grp") % 7).alias("gx"), (F.col("grp") % 5).alias("gy")))
    family = F.element_at(
        F.array(*[F.lit(x) for x in ("doorkey", "memory", "lavagap", "multiroom", "keycorridor", "redblue", "other")]),
        (F.col("grp") % 7).cast("int") + 1,
    )
    return arrays.join(heads, ["group_id", "variant"]).select(
        "group_id", "env_task", "variant", "grp", "success", "terminated", "truncated", "reward",
        family.alias("env_family"),
        F.split("input_fields", ",").alias("input_fields"),
        F.transform(F.slice("_s", 1, n - 1), lambda s: s["action"]).alias("actions"),
        F.transform("_s", lambda s: s["state"]).alias("states"),
        F.transform("_s", lambda s: F.array(s["visible"])).alias("visible"),
        F.transform(F.sequence(F.lit(1), n - F.col("frames_short").cast("int")), lambda i: F.concat(F.lit("frames/"), i)).alias("frames"),
        cf_goal.alias("cf_goal"), F.lit("Reach the goal.").alias("mission"),
    )


FIELDS = ["actions", "frames", "states", "success", "terminated", "truncated", "reward"]


def pivoted(fx: Fixtures) -> DataFrame:
    return J.pivot_variants(trajectories(fx), ["group_id", "env_task"], G.VARIANTS, FIELDS, F.size("frames"))


def checkpoints(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    steps = fx("steps")
    ev = landed(Q.carry_events(steps), "events")
    return Q.propose_checkpoints(Q.first_pickups(steps, ev)), ev


# ---------------------------------------------------------------- W*


@query("w3_carry_events")
def _(fx):
    return Q.carry_events(fx("steps"))


@query("w4_carry_summary")
def _(fx):
    return Q.carry_summary(fx("steps"))


@query("w5_first_steps")
def _(fx):
    return fx("steps").groupBy("group_id").agg(
        Q.first_step(F.col("visible") == "key").alias("key_seen"),
        Q.first_step(F.col("visible") == "lava", 20).alias("lava_seen_from_20"),
        Q.first_step(F.col("action") == 5, 3).alias("toggle_from_3"),
        Q.first_step(F.col("action") == 7).alias("never"),
    )


@query("w6_storyboard")
def _(fx):
    t = trajectories(fx).filter("variant = 'full'")
    return Q.with_storyboard(t, 8).select("group_id", "env_family", F.array_join("board", ",").alias("frames"))


@query("w6_storyboard_variants")
def _(fx):
    """nocue reuses the full variant's frames where they fit; cf gets its own."""
    t = Q.with_storyboard(trajectories(fx), 8).withColumn("n", F.size("states"))
    p = J.pivot_variants(t, ["group_id"], G.VARIANTS, ["board", "n"], F.size("states"))
    p = p.filter("full IS NOT NULL AND nocue IS NOT NULL AND cf IS NOT NULL")
    reuse = F.array_max("full.board") < F.col("nocue.n")
    return p.select(
        "group_id", F.array_join("full.board", ",").alias("full_frames"), F.array_join("cf.board", ",").alias("cf_frames"),
        F.array_join(F.when(reuse, F.col("full.board")).otherwise(F.col("nocue.board")), ",").alias("nocue_frames"),
        reuse.alias("aligned"),
    )


@query("w7_status_as_of")
def _(fx):
    """Status of every label at every checkpoint of exam E."""
    q = fx("exam_e").select("uid", "group_id", F.col("query_step"), F.concat(F.lit("obj"), F.col("item_no") % 4).alias("label"))
    return Q.status_as_of(Q.carry_events(fx("steps")), q)


@query("w8_checkpoint_proposals")
def _(fx):
    p, _ = checkpoints(fx)
    return p.select("group_id", "label", "pickup_step", "drop_step", "n_steps", "sampling_role", "query_step", "horizon_gap", "horizon_bucket")


@query("w9_accept_proposals")
def _(fx):
    p, ev = checkpoints(fx)
    return Q.judge_proposals(p, ev).select("group_id", "sampling_role", "query_step", "status", "decision", "answer")


@query("w9_reject_counts")
def _(fx):
    steps = fx("steps")
    ev = landed(Q.carry_events(steps), "events")
    p = Q.propose_checkpoints(Q.first_pickups(steps, ev, same_label_drop=False))
    return Q.judge_proposals(p, ev).groupBy("sampling_role", "decision").agg(F.count("*").alias("n"))


@query("w10_prefix_frames")
def _(fx):
    e = fx("exam_e")
    f = Q.prefix_frames(F.col("query_step"), F.col("anchor_step"))
    return e.select("uid", F.array_join(f, ",").alias("frames"), F.size(f).alias("n_frames"))


@query("w11_transitions")
def _(fx):
    return Q.transitions(fx("steps").select("group_id", "env_task", "t", "action", *STATE), ["x", "y", "dir", "carry"])


@query("w12_row_numbers")
def _(fx):
    e = fx("exam_e").select("uid", "env_task", "item_no")
    n = Q.number_rows(e, ["env_task"], ["item_no"], F.floor(F.col("item_no") / 65536))
    return n.select("uid", "env_task", F.concat(F.lit("q"), F.lpad(F.col("idx").cast("string"), 6, "0")).alias("row_id"))


@query("w14_region_entry")
def _(fx):
    region = fx("nation").select(
        F.concat(F.lit("env"), F.col("n_regionkey")).alias("env_task"), (F.col("n_nationkey") % 7).cast("bigint").alias("x"),
        (F.col("n_nationkey") * 3 % 7).cast("bigint").alias("y"),
    )
    return Q.first_in_region(fx("steps").select("group_id", "env_task", "t", "x", "y"), region)


# ---------------------------------------------------------------- J6, V*


@query("j6_variant_pivot")
def _(fx):
    p = pivoted(fx)
    return p.select(
        "group_id", "env_task", *[F.size(f"{v}.actions").alias(f"n_{v}") for v in G.VARIANTS],
        *[F.col(f"{v}.success").alias(f"success_{v}") for v in G.VARIANTS],
    ).withColumn("n_cf", F.when(F.col("n_cf") >= 0, F.col("n_cf")))


@query("v1_complete_groups")
def _(fx):
    return G.complete_groups(fx("exam_c"), G.VARIANTS, ["group_id"], exact=True)


@query("v2_hard_gates")
def _(fx):
    """Some groups have a variant too many."""
    t = trajectories(fx)
    t = t.unionByName(t.filter("variant = 'full' AND grp % 11 = 5").withColumn("variant", F.lit("extra")))
    p = J.pivot_variants(t, ["group_id", "env_task"], G.VARIANTS, FIELDS, F.size("frames"), others="n_other")
    return G.hard_gates(p).select("group_id", "reason")


@query("v3_contract_fields")
def _(fx):
    return G.contract_fields(trajectories(fx)).select("group_id", "variant", "reason")


@query("v3_contract_strict")
def _(fx):
    t = trajectories(fx).drop("terminated")
    allowed = ["frames", "mission", "reward", "terminated"]
    return G.contract_fields(t, allowed=allowed).select("group_id", "variant", "reason")


@query("v4_outcome_gates")
def _(fx):
    p = pivoted(fx).filter("full IS NOT NULL AND nocue IS NOT NULL AND cf IS NOT NULL")
    return G.outcome_gates(p).select("group_id", "reason")


@query("v5_physics_identity")
def _(fx):
    return G.physics_identity(fx("variant_steps"))


@query("v6_state_encoding")
def _(fx):
    code = lambda i, j: (F.col("event_id") * 31 + 7 * i + 3 * j) % 12
    state = lambda i, j: F.when(code(i, j) == 4, F.col("event_id") % 4).when(
        F.col("event_id") % 97 == 0, F.lit(1)
    ).otherwise(F.lit(0))
    cell = lambda i, j: F.array(code(i, j), F.lit(0), state(i, j))
    rows = F.when(F.col("event_id") % 501 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.sequence(F.lit(0), F.lit(2)))
    enc = F.transform(rows, lambda i: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: cell(i, j)))
    return G.encoding_report(fx("steps").withColumn("encoding", enc))


def event_order(fx: Fixtures) -> DataFrame:
    outcome = fx("headers").filter("variant = 'cf'").select("group_id", F.col("success").alias("cf_success"))
    facts = fx("steps").select("group_id").distinct().join(fx("doors"), "group_id", "left").join(outcome, "group_id", "left")
    return G.event_order(fx("door_steps"), facts.drop("door_at"))


@query("v7_event_order")
def _(fx):
    return event_order(fx).select("group_id", "pickup_t", "door_t", "goal_t", "reason")


@query("v8_follow_up")
def _(fx):
    return event_order(fx).filter("door_t IS NOT NULL").select("group_id", "opened", "entered")


@query("v8_toggle_gate")
def _(fx):
    return G.toggle_gate(fx("door_steps"))


@query("v8_toggle_gate_objects")
def _(fx):
    """Door objects of the next state say whether the door acted on is open."""
    d = fx("door_steps")
    doors = d.filter("event_id % 3 <> 0").select("group_id", (F.col("t") + 1).alias("t"), F.col("fx").alias("px"), F.col("fy").alias("py"), F.when(F.col("grp") % 2 == 0, 0).otherwise(F.col("door_state")).alias("state"))
    return G.toggle_gate(d, doors=doors)


@query("v9_never_visible")
def _(fx):
    goals = fx("headers").filter("variant = 'cf'").select("group_id", (F.col("grp") % 7).alias("gx"), (F.col("grp") % 5).alias("gy"))
    v = fx("variant_steps")
    return G.never_visible(v.withColumn("visible", F.when(F.col("grp") % 3 != 0, F.col("visible"))), "goal").join(
        G.goal_on_path(v, goals), "group_id"
    )


@query("v10_crossed_barrier")
def _(fx):
    hazards = fx("steps").filter("t % 16 = 1 AND grp % 8 <> 7").select("group_id", ((F.col("x") + 2) % 7 + F.when(F.col("grp") % 3 == 0, 7).otherwise(0)).alias("hx"), ((F.col("y") + 3) % 7).alias("hy"))
    # in every third group the hazards lie beside the path
    return G.crossed_barrier(fx("steps"), hazards)


@query("v11_mask_window")
def _(fx):
    steps = fx("steps")
    limits = steps.filter("action = 5 AND front_type = 'door'").groupBy("group_id").agg((F.min("t") + 12).alias("end_t"))
    return G.mask_window(steps, limits, F.col("visible") == "door", F.col("front_type") == "door", 3)


@query("v11_corridor_window")
def _(fx):
    return G.corridor_window(fx("steps"), F.col("visible") == "ball", F.col("front_color") == "red", 3, 5)


@query("v11_corridor_steps")
def _(fx):
    return G.corridor_steps(fx("steps"), F.col("visible") == "ball", F.col("front_color") == "red", 3, 5)


@query("v11_first_seen_window")
def _(fx):
    steps = fx("steps")
    vis = F.col("visible") == "door"
    limits = G.first_seen_limits(steps, vis, (F.col("action") == 5) & (F.col("front_type") == "door"))
    return G.mask_window(steps, limits, vis, (F.col("front_type") == "door") & (F.col("front_color") == "red"), 3)


@query("v12_mask_metrics")
def _(fx):
    return G.mask_metrics(fx("grid_cells"), 0.25, 0.95)


@query("v12_meta_gates")
def _(fx):
    """Declared masks of the nocue headers, with a fault in most of the group classes."""
    h = fx("headers").filter("variant = 'nocue'")
    k = F.col("grp") % 11
    steps = F.when(k == 4, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("grp") % 3))
    meta = F.struct(
        F.when(k == 1, F.lit("LATE")).otherwise(F.lit("EARLY")).alias("window_policy"),
        F.when(k == 2, F.array(F.lit("door"))).otherwise(F.array(F.lit("goal"), F.lit("door"))).alias("targets"),
        steps.alias("window_steps"), (F.size(steps) + F.when(k == 5, 1).otherwise(0)).alias("masked_frames"),
        F.when(k == 6, 0.9).otherwise(0.1).alias("mask_strength_actual"), F.lit(0.3).alias("mask_strength_threshold"),
        F.when(k == 7, 0.5).otherwise(0.99).alias("alignment_score"), F.lit(0.95).alias("alignment_threshold"),
        F.when(k == 8, 50).otherwise(5).alias("masked_tiles_total"), F.lit(10).alias("mask_budget_tiles"),
    )
    d = h.select("group_id", F.when(k != 3, meta).alias("nocue_meta"), F.when(k == 9, 2).otherwise(10).alias("first_interaction"))
    return G.mask_meta_gates(d, ["door", "goal"]).select("group_id", "reason")


@query("v15_masked_cell_diff")
def _(fx):
    return G.masked_cell_diff(fx("grid_cells"))


@query("v17_audit_report")
def _(fx):
    g = G.hard_gates(pivoted(fx)).withColumn("n_frames", F.size("full.frames"))
    return G.audit_report(g, measures=["n_frames"])
