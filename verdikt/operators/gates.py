"""Quality gates over trajectories, steps, grid cells, exams and requests.

A gate either yields a reason per group (the first check that fails, null if it passes) or one row per
check.  Facts about steps are aggregated per (group, step) or per group with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import col, first_reason, n_where, ratio
from .joins import block_join
from .sequence import with_neighbour

# Fixed values.
VARIANTS = ["full", "nocue", "cf"]
# Reasons of the variant, event and toggle gates.
REASONS = {
    "variants": "missing_variant",
    "no_door": "missing_locked_door",
    "no_event": "semantic_event_missing",
    "order": "semantic_seq_fail",
    "unlocked": "door_not_locked",
    "closed": "door_not_open",
    "not_entered": "did_not_enter_after_door",
    "few_toggles": "toggles_lt_2",
    "toggle_elsewhere": "toggle_non_door",
    "toggle_last": "toggle_last_step",
    "toggle_lost": "door_obj_missing",
}
ALLOWED_INPUTS = ["frames", "mission", "terminated", "truncated"]
PROHIBITED_INPUTS = ["state_seq", "actions_id", "success", "reward", "cf_meta", "nocue_meta", "seed"]
DOOR_OPEN, DOOR_LOCKED = 0, 2
ENCODED_TYPES = ["unseen", "empty", "wall", "floor", "door", "key", "ball", "box", "goal", "lava", "agent"]


def complete_groups(df: DataFrame, required: Sequence[str], keys: Sequence[str], exact: bool = False) -> DataFrame:
    """Keys with ``complete``: all required variants are there (and, if ``exact``, no others)."""
    have = [F.max((F.col("variant") == v).cast("int")) == 1 for v in required]
    only = F.min(F.col("variant").isin(*required).cast("int")) == 1
    cond = have[0]
    for h in have[1:]:
        cond = cond & h
    return df.groupBy(*keys).agg((cond & only if exact else cond).alias("complete"), F.count("*").alias("n_rows"))


def _in(variant: str, field: str) -> Column:
    return F.col(f"{variant}.{field}")


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def hard_gates(pivoted: DataFrame, others: str = "n_other") -> DataFrame:
    """Variant set, lengths, equal actions, equal outcome of full and nocue.

    A group with records of other variants (counted in ``others``, if there is such a column) has the wrong set as well.
    """
    lengths = []
    for v in VARIANTS:
        n = F.size(_in(v, "actions")) + 1
        lengths += [(F.size(_in(v, "frames")) != n, f"{v}_len_mismatch"), (F.size(_in(v, "states")) != n, f"{v}_state_len_mismatch")]
    missing = F.col("full").isNull() | F.col("nocue").isNull() | F.col("cf").isNull()
    if others in pivoted.columns:
        missing = missing | (F.col(others) > 0)
    reason = first_reason(
        (missing, REASONS["variants"]),
        *lengths,
        (_differs(_in("full", "actions"), _in("nocue", "actions")) | _differs(_in("full", "actions"), _in("cf", "actions")), "action_mismatch"),
        *[(_differs(_in("full", f), _in("nocue", f)), f"nocue_{f}_mismatch") for f in ("success", "terminated", "truncated", "reward")],
    )
    return pivoted.withColumn("reason", reason)


def contract_fields(
    df: DataFrame, fields: str = "input_fields", allowed: Sequence[str] = ALLOWED_INPUTS, prohibited: Sequence[str] = PROHIBITED_INPUTS
) -> DataFrame:
    """Declared model inputs: all allowed, all present as columns, none prohibited."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    reason = first_reason(
        (F.size(F.array_except(fields, lits(allowed))) > 0, "bad_contract_fields"),
        (F.size(F.array_except(fields, lits(df.columns))) > 0, "missing_contract_data"),
        (F.arrays_overlap(fields, lits(prohibited)), "info_leak"),
    )
    return df.withColumn("reason", reason)


def outcome_gates(pivoted: DataFrame) -> DataFrame:
    full, nocue, cf = "full", "nocue", "cf"
    reason = first_reason(
        (~F.coalesce(_in(full, "terminated"), F.lit(False)), "full_not_terminated"),
        (F.coalesce(_in(cf, "terminated"), F.lit(False)), "cf_terminated_error"),
        (F.coalesce(_in(cf, "truncated"), F.lit(False)), "cf_truncated_error"),
        (_differs(_in(nocue, "terminated"), _in(full, "terminated")), "nocue_term_mismatch"),
        (
            ~F.coalesce(_in(full, "success"), F.lit(False)) | ~F.coalesce(_in(nocue, "success"), F.lit(False)) | F.coalesce(_in(cf, "success"), F.lit(False)),
            "outcome_fail",
        ),
        (~(F.coalesce(_in(full, "reward"), F.lit(0.0)) > 0), "full_reward_not_positive"),
        (F.coalesce(_in(cf, "reward"), F.lit(0.0)) != 0.0, "cf_reward_nonzero"),
    )
    return pivoted.withColumn("reason", reason)


def physics_identity(steps: DataFrame, fields: Sequence[str] = ("x", "y", "dir")) -> DataFrame:
    """First step at which a variant's pose differs from the full one, over groups with all variants."""
    pose = F.struct(*fields)
    per_step = steps.groupBy("group_id", "t").agg(
        *[F.max(F.when(F.col("variant") == v, pose)).alias(v) for v in VARIANTS]
    )
    drift = lambda v: F.min(F.when(_differs(F.col("full"), F.col(v)), F.col("t")))
    have = F.count("full").alias("_f"), F.count("nocue").alias("_n"), F.count("cf").alias("_c")
    out = per_step.groupBy("group_id").agg(*have, drift("nocue").alias("nocue_drift_t"), drift("cf").alias("cf_drift_t"))
    return out.filter("_f > 0 AND _n > 0 AND _c > 0").drop("_f", "_n", "_c")


def encoding_valid(enc: Column) -> Column:
    """An H×W×3 grid of known types; only doors carry a state (0..2), besides empty and unseen cells."""
    code = {n: i for i, n in enumerate(ENCODED_TYPES)}

    def cell_ok(c: Column) -> Column:
        kind, state = F.get(c, F.lit(0)), F.get(c, F.lit(2))
        return (
            (F.size(c) == 3)
            & kind.between(0, len(ENCODED_TYPES) - 1)
            & F.when(kind == code["door"], state.between(0, 2))
            .when(kind.isin(code["empty"], code["unseen"]), F.lit(True))
            .otherwise(state == 0)
        )

    width = F.size(F.get(enc, F.lit(0)))
    return enc.isNotNull() & F.forall(enc, lambda row: (F.size(row) == width) & F.forall(row, cell_ok))


def encoding_report(steps: DataFrame, enc: str = "encoding") -> DataFrame:
    """Per group: steps with an invalid encoding, the first of them, and the number of different shapes."""
    shape = F.struct(F.size(enc), F.size(F.get(F.col(enc), F.lit(0))))
    bad = ~encoding_valid(F.col(enc))
    return steps.groupBy("group_id").agg(
        n_where(bad).alias("n_bad"), F.min(F.when(bad, F.col("t"))).alias("first_bad_t"), F.count_distinct(shape).alias("n_shapes")
    )


def event_order(
    steps: DataFrame,
    facts: DataFrame,
    key: Column | None = None,
    goal: Column | None = None,
    use_actions: Sequence[int] = (2, 5),
    pick_action: int = 3,
    opens_within: int = 4,
    enters_within: int = 7,
) -> DataFrame:
    """Key pickup, then the locked door, then the goal; the door opens, and the agent walks through it.

    ``facts`` gives one row per group: the locked door at the start (door_x, door_y, door_color; null if there is none)
    and ``cf_success``, whether the counterfactual run reached its goal.  Only a key of the door's colour and only this
    door count.  ``key`` and ``goal`` are conditions on a step (the goal is the mission's target).
    """
    key = F.col("front_type") == "key" if key is None else key
    goal = F.col("front_type") == "ball" if goal is None else goal
    last = steps.groupBy("group_id").agg(F.max("t").alias("_last"))
    s = block_join(steps, last.join(facts, "group_id", "left"), ["group_id"], "_last")
    at_door = (F.col("front_type") == "door") & (F.col("fx") == F.col("door_x")) & (F.col("fy") == F.col("door_y"))
    picked = F.col("action") == pick_action
    g = s.groupBy("group_id").agg(
        F.max("door_x").alias("door_x"),
        F.max("door_y").alias("door_y"),
        F.max(F.coalesce("cf_success", F.lit(True))).alias("cf_success"),
        F.min(F.when(picked & key & (F.col("front_color") == F.col("door_color")), F.col("t"))).alias("pickup_t"),
        F.min(F.when(F.col("action").isin(*use_actions) & at_door, F.struct("t", "door_state"))).alias("_door"),
        F.min(F.when(picked & goal, F.col("t"))).alias("goal_t"),
    )
    anchors = g.select("group_id", "door_x", "door_y", F.col("_door.t").alias("anchor_t"))
    opened = follow_up(steps, anchors, at_door & (F.col("door_state") == DOOR_OPEN), opens_within, "opened")
    entered = follow_up(steps, anchors, (F.col("x") == F.col("door_x")) & (F.col("y") == F.col("door_y")), enters_within, "entered")
    g = g.join(opened, "group_id", "left").join(entered, "group_id", "left")
    door_t = F.col("_door.t")
    reason = first_reason(
        (F.col("door_x").isNull(), REASONS["no_door"]),
        (F.col("pickup_t").isNull() | door_t.isNull(), REASONS["no_event"]),
        (F.col("goal_t").isNull() & F.col("cf_success"), REASONS["no_event"]),
        (F.col("pickup_t") >= door_t, REASONS["order"]),
        (F.col("goal_t") <= door_t, REASONS["order"]),
        (F.col("_door.door_state") != DOOR_LOCKED, REASONS["unlocked"]),
        (~F.col("opened"), REASONS["closed"]),
        (~F.col("entered"), REASONS["not_entered"]),
    )
    return g.select("group_id", "pickup_t", door_t.alias("door_t"), "goal_t", "opened", "entered", reason.alias("reason"))


def follow_up(steps: DataFrame, anchors: DataFrame, cond: Column, horizon: int, name: str) -> DataFrame:
    """Whether a condition holds on one of the ``horizon`` steps after each group's anchor step ``anchor_t``.

    The condition may use columns of ``steps`` and further ones of ``anchors``.  The steps to look at are named one by
    one, so the join is on (group, step) and knows no hot group.
    """
    asked = anchors.filter(F.col("anchor_t").isNotNull()).withColumn("t", F.explode(F.sequence(F.col("anchor_t") + 1, F.col("anchor_t") + horizon)))
    held = asked.join(steps, ["group_id", "t"], "left").withColumn("_c", F.coalesce(cond, F.lit(False)))
    return held.groupBy("group_id").agg(F.max("_c").alias(name))


def toggle_gate(steps: DataFrame, minimum: int = 2, doors: DataFrame | None = None) -> DataFrame:
    """Every toggle hits a door that is open right after; there are at least ``minimum`` toggles.

    The state after a toggle is that of the door acted on: from ``doors`` (group_id, t, px, py, state of door objects), if
    they are given, else from the cell in front if it is the same one.
    """
    cols = ["front_type", "fx", "fy", "door_state"]
    s = with_neighbour(steps.select("group_id", "t", "action", *cols), {f"next_{c}": c for c in cols}, +1)
    tog = s.filter(F.col("action") == 5)
    same = (F.col("next_front_type") == "door") & (F.col("next_fx") == F.col("fx")) & (F.col("next_fy") == F.col("fy"))
    state = F.when(same, F.col("next_door_state"))
    if doors is not None:
        after = doors.select("group_id", (F.col("t") - 1).alias("t"), F.col("px").alias("fx"), F.col("py").alias("fy"), F.col("state").alias("_state"))
        tog = tog.join(after, ["group_id", "t", "fx", "fy"], "left")
        state = F.coalesce("_state", state)
    fault = first_reason(
        (F.col("front_type") != "door", REASONS["toggle_elsewhere"]),
        (F.col("next_front_type").isNull(), REASONS["toggle_last"]),
        (state.isNull(), REASONS["toggle_lost"]),
        (state != DOOR_OPEN, REASONS["closed"]),
    )
    faults = tog.groupBy("group_id").agg(F.count("*").alias("n_toggles"), F.min(F.when(fault.isNotNull(), F.struct("t", fault.alias("reason")))).alias("_f"))
    g = steps.select("group_id").distinct().join(faults, "group_id", "left").withColumn("n_toggles", F.coalesce("n_toggles", F.lit(0)))
    return g.select("group_id", "n_toggles", F.when(F.col("n_toggles") < minimum, F.lit(REASONS["few_toggles"])).otherwise(F.col("_f.reason")).alias("reason"))


def never_visible(steps: DataFrame, target: str) -> DataFrame:
    """Counterfactual steps must not show the target."""
    return steps.filter("variant = 'cf'").groupBy("group_id").agg(
        F.max((F.col("visible") == target).cast("int")).cast("boolean").alias("target_visible")
    )


def path_cells(steps: DataFrame) -> DataFrame:
    """The cells a group visits, each once: a grid's worth of rows however long the path is."""
    return steps.select("group_id", "x", "y").distinct()


def goal_on_path(steps: DataFrame, goals: DataFrame) -> DataFrame:
    """Whether the path crosses the cell the goal was moved to (``gx``, ``gy`` per group)."""
    j = path_cells(steps.filter("variant = 'full'")).join(goals, "group_id")
    hit = (F.col("x") == F.col("gx")) & (F.col("y") == F.col("gy"))
    return j.groupBy("group_id").agg(F.max(hit).alias("goal_on_path"))


def crossed_barrier(steps: DataFrame, hazards: DataFrame) -> DataFrame:
    """Never on a hazard cell, and rows on both sides of the most frequent hazard row (ties: smallest)."""
    wall = hazards.groupBy("group_id").agg(F.mode("hy", True).alias("wall_y"))
    cells = hazards.select("group_id", F.col("hx").alias("x"), F.col("hy").alias("y"), F.lit(True).alias("_on")).distinct()
    g = path_cells(steps).join(cells, ["group_id", "x", "y"], "left").groupBy("group_id").agg(
        F.max(F.coalesce("_on", F.lit(False))).alias("on_hazard"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )
    out = g.join(wall, "group_id", "left")
    reason = first_reason(
        (F.col("wall_y").isNull(), "no_hazard_found"),
        (F.col("on_hazard"), "stepped_on_hazard"),
        (~((F.col("min_y") < F.col("wall_y")) & (F.col("wall_y") < F.col("max_y"))), "did_not_cross_wall"),
    )
    return out.select("group_id", "wall_y", "min_y", "max_y", reason.alias("reason"))


# ---------------------------------------------------------------- masking


def mask_window(steps: DataFrame, limits: DataFrame, visible: Column, evidence: Column, max_visible: int) -> DataFrame:
    """Roles of the early steps in which a target shows: masked, leak or excluded (interaction evidence).

    ``limits`` holds ``end_t`` per group; the first ``max_visible`` usable steps before it are masked.
    One row per step, so a group's list can be of any length.
    """
    early = block_join(steps.filter(visible), limits.select("group_id", "end_t"), ["group_id"], "end_t").filter(F.col("t") < F.col("end_t"))
    early = early.select("group_id", "t", F.coalesce(evidence, F.lit(False)).alias("excluded"))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("t"))
    cut = (
        early.filter(~F.col("excluded"))
        .select("group_id", "t", rank.alias("_k"))
        .filter(F.col("_k") <= max_visible)
        .groupBy("group_id")
        .agg(F.max("t").alias("last_masked"))
    )
    out = block_join(early, cut, ["group_id"], "last_masked", "left")
    role = (
        F.when(F.col("excluded"), F.lit("excluded")).when(F.col("t") <= F.col("last_masked"), F.lit("masked")).otherwise(F.lit("leak"))
    )
    return out.select("group_id", "t", role.alias("role"))


def corridor_window(steps: DataFrame, visible: Column, evidence: Column, corridor_x: int, max_visible: int) -> DataFrame:
    """Window rule for recall tasks: all usable sightings before the corridor, rejected if none or too many."""
    ahead = steps.filter(F.col("x") < corridor_x)
    ev = F.coalesce(evidence, F.lit(False))
    g = ahead.groupBy("group_id").agg(
        n_where(visible & ~ev).alias("n_visible"),
        F.max(F.when(visible & ~ev, F.col("t"))).alias("_end"),
        n_where(ev).alias("n_excluded"),
    )
    ok = F.col("n_visible").between(1, max_visible)
    return g.select("group_id", "n_visible", "n_excluded", F.when(ok, F.col("_end")).otherwise(F.lit(-1)).alias("window_end"), ok.alias("accepted"))


def corridor_steps(steps: DataFrame, visible: Column, evidence: Column, corridor_x: int, max_visible: int) -> DataFrame:
    """Role of every step of the corridor rule: ``masked`` in an accepted window, ``void`` in a rejected one, ``excluded``.

    Steps at or behind the corridor have no role.  A sighting before the corridor always extends the window, so none is left
    over as a leak.  Null evidence is none; a null ``visible`` or ``x`` is no sighting.  One row per step: groups are only
    counted as wholes, and the verdict comes back block by block.
    """
    ev = F.coalesce(evidence, F.lit(False))
    ahead = steps.filter(F.col("x") < corridor_x).select("group_id", "t", ev.alias("_ev"), F.coalesce(visible, F.lit(False)).alias("_vis"))
    ahead = ahead.filter("_ev OR _vis")
    windows = ahead.groupBy("group_id").agg(n_where(~F.col("_ev")).alias("_n"), F.max("t").alias("_last"))
    role = (
        F.when(F.col("_ev"), F.lit("excluded")).when(F.col("_n").between(1, max_visible), F.lit("masked")).otherwise(F.lit("void"))
    )
    return block_join(ahead, windows, ["group_id"], "_last").select("group_id", "t", role.alias("role"))


def first_seen_limits(steps: DataFrame, visible: Column, interact: Column) -> DataFrame:
    """``end_t`` for the rule that masks up to the first sighting, but only before the interaction."""
    g = steps.groupBy("group_id").agg(F.min(F.when(visible, F.col("t"))).alias("seen"), F.min(F.when(interact, F.col("t"))).alias("act"))
    end = F.least(F.col("seen"), F.col("act") - 1)
    return g.filter("seen IS NOT NULL AND act IS NOT NULL").filter(end >= 0).select("group_id", (end + 1).alias("end_t"))


def mask_metrics(cells: DataFrame, ratio_max: float, alignment_min: float) -> DataFrame:
    """Mask ratios and budget over the masked steps of each group, with the first limit that is broken.

    A step's ratio is its share of masked cells; its alignment is the share of changed cells that are
    target cells.
    """
    step = (
        cells.filter("masked")
        .groupBy("group_id", "t")
        .agg(
            F.count("*").alias("n_cells"),
            n_where(F.col("is_target")).alias("n_masked"),
            n_where(F.col("v") != F.col("v_nocue")).alias("n_changed"),
            n_where((F.col("v") != F.col("v_nocue")) & F.col("is_target")).alias("n_aligned"),
        )
    )
    g = step.groupBy("group_id").agg(
        F.count("*").alias("masked_frames"),
        F.max(ratio(F.col("n_masked"), F.col("n_cells"))).alias("_max"),
        F.avg(ratio(F.col("n_masked"), F.col("n_cells"))).alias("_avg"),
        F.avg(F.coalesce(ratio(F.col("n_aligned"), F.col("n_changed")), F.lit(0.0))).alias("_align"),
        F.sum("n_masked").alias("masked_tiles"),
        F.max("n_cells").alias("_grid"),
    )
    budget = F.floor(F.lit(ratio_max) * F.col("_grid") * F.col("masked_frames"))
    reason = first_reason(
        (F.col("_align") < alignment_min, "alignment_fail"),
        (F.col("_max") > ratio_max, "mask_ratio_exceeded"),
        (F.col("masked_tiles") > budget, "mask_budget_exceeded"),
    )
    return g.select(
        "group_id", "masked_frames", F.round("_max", 6).alias("max_ratio"), F.round("_avg", 6).alias("avg_ratio"),
        F.round("_align", 6).alias("alignment"), "masked_tiles", budget.alias("budget_tiles"), reason.alias("reason"),
    )


def mask_meta_gates(df: DataFrame, targets: Sequence[str], meta: str = "nocue_meta", limit: str = "first_interaction") -> DataFrame:
    """What a masked variant declares about itself: policy, targets, counts, strength, alignment, budget, window."""
    m = lambda f: F.col(f"{meta}.{f}")
    want = F.array(*[F.lit(t) for t in targets])
    odd = F.concat(F.array_except(m("targets"), want), F.array_except(want, m("targets")))
    reason = first_reason(
        (F.col(meta).isNull(), "missing_nocue_meta"),
        (~m("window_policy").eqNullSafe(F.lit("EARLY")), "bad_window_policy"),
        (m("targets").isNull() | (F.size(odd) > 0), "nocue_targets_bad"),
        (F.size(m("window_steps")) <= 0, "empty_mask"),
        (~m("masked_frames").eqNullSafe(F.size(m("window_steps"))), "nocue_mask_count_mismatch"),
        (m("mask_strength_actual") > m("mask_strength_threshold"), "nocue_mask_strength_exceeded"),
        (m("alignment_score") < m("alignment_threshold"), "nocue_alignment_fail"),
        (m("masked_tiles_total") > m("mask_budget_tiles"), "budget_exceeded"),
        (F.exists(m("window_steps"), lambda t: t >= F.col(limit)), "mask_outside_window"),
    )
    return df.withColumn("reason", reason)


def masked_cell_diff(cells: DataFrame, left: str = "v", right: str = "v_nocue") -> DataFrame:
    """Where a masked variant differs: only in target cells of masked steps, and there at least once."""
    diff = _differs(F.col(left), F.col(right))
    step = cells.groupBy("group_id", "t").agg(
        F.max("masked").alias("masked"),
        F.max(diff & ~F.col("is_target")).alias("outside"),
        F.max(diff & F.col("is_target")).alias("inside"),
        F.max("is_target").alias("has_target"),
    )
    g = step.groupBy("group_id").agg(
        F.min(F.when(~F.col("masked") & (F.col("outside") | F.col("inside")), F.col("t"))).alias("unmasked_diff_t"),
        F.min(F.when(F.col("masked") & F.col("outside"), F.col("t"))).alias("outside_t"),
        F.min(F.when(F.col("masked") & F.col("has_target") & ~F.col("inside"), F.col("t"))).alias("no_diff_t"),
    )
    reason = first_reason(
        (F.col("outside_t").isNotNull(), "diff_outside_target"),
        (F.col("no_diff_t").isNotNull(), "no_diff_inside_target"),
        (F.col("unmasked_diff_t").isNotNull(), "diff_unmasked"),
    )
    return g.withColumn("reason", reason)


# ---------------------------------------------------------------- exams, assets, requests


def exam_gates(exam: DataFrame, inventory: DataFrame, label_space: Sequence[str], steps: str = "selected_steps") -> DataFrame:
    """One row per gate: how many rows or keys break it, and the first one that does as ``sample``."""

    def broken(cond: Column, what: Column, name: str) -> Column:
        return F.struct(n_where(cond).alias("n_bad"), F.min(F.when(cond, what)).alias("sample")).alias(name)

    one = exam.agg(
        broken(F.exists(steps, lambda s: s > F.col("query_step")), F.col("uid"), "future_steps"),
        broken(~F.coalesce(F.col("answer").isin(*label_space), F.lit(False)), F.col("uid"), "answer_outside_space"),
    )
    # both uniqueness gates in one aggregation: a row stands once for its uid and once for its question
    part = ["uid", "group_id", "query_type", "query_step"]
    key = lambda name, used: F.struct(
        F.lit(name).alias("gate"), *[(F.col(c) if c in used else F.lit(None)).cast("string").alias(c) for c in part]
    )
    keys = F.explode(F.array(key("uid_unique", part[:1]), key("duplicate_query", part[1:])))
    dup = exam.select(keys.alias("k")).select("k.*").groupBy("gate", *part).count().filter("count > 1")
    two = dup.agg(*[broken(F.col("gate") == g, F.concat_ws("|", *part), g) for g in ("uid_unique", "duplicate_query")])
    lost = exam.select("image").join(inventory.select(F.col("path").alias("image")).distinct(), "image", "left_anti")
    three = lost.agg(broken(F.lit(True), F.col("image"), "asset_missing"))

    def as_rows(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("gate"), F.col(f"{c}.n_bad").alias("n_bad"), F.col(f"{c}.sample").alias("sample")) for c in df.columns])
        return df.select(F.explode(pairs).alias("g")).select("g.*")

    out = as_rows(one).unionByName(as_rows(two)).unionByName(as_rows(three))
    return out.withColumn("passed", F.col("n_bad") == 0)


def asset_duplicates(assets: DataFrame, keys: Sequence[str], content: str | Column) -> DataFrame:
    """Per key: assets, different contents, and assets that share their content with another one."""
    per_hash = assets.groupBy(*keys, F.md5(col(content).cast("binary")).alias("hash")).agg(F.count("*").alias("n"))
    return per_hash.groupBy(*keys).agg(
        F.sum("n").alias("n_total"),
        F.count("*").alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_colliding"),
    )


def colliding_assets(assets: DataFrame, keys: Sequence[str], content: str | Column, uid: str) -> DataFrame:
    """The assets behind the collisions, one row each.

    Nothing is grouped after the join, so adaptive execution may split a content with very many copies.
    """
    a = assets.select(*keys, uid, F.md5(col(content).cast("binary")).alias("hash"))
    many = a.groupBy(*keys, "hash").agg(F.count("*").alias("n_copies")).filter("n_copies > 1")
    return a.join(many, [*keys, "hash"])


# Marks of a request that was refused before it was sent.
REFUSED_ERROR = "D7_VIOLATION:"
REFUSED_FINISH = "d7_rejected"


def refused(requests: DataFrame, found: Column) -> DataFrame:
    """Requests with ``violations``; a row that has some becomes a refused response."""
    # the list is made before it is tested, so that it is made once
    bad = F.size("violations") > 0
    return requests.withColumn("violations", found).withColumns(
        {
            "blocked": bad,
            "error": F.when(bad, F.concat(F.lit(REFUSED_ERROR), F.array_join("violations", ","))),
            "finish_reason": F.when(bad, F.lit(REFUSED_FINISH)),
        }
    )


def payload_scan(requests: DataFrame, terms: Sequence[str], prompt: str = "prompt") -> DataFrame:
    """Forbidden terms found in each prompt; a hit turns the request into a refused response.

    Every term searches the prompt anew, which suits a handful; ``terms.automaton_scan`` reads it once for any number.
    """
    low = F.lower(F.coalesce(F.col(prompt), F.lit("")))
    listed = F.array(*[F.lit(t.lower()) for t in terms]).cast("array<string>")
    return refused(requests, F.filter(listed, lambda t: F.contains(low, t)))


def audit_report(gated: DataFrame, keys: Sequence[str] = (), measures: Sequence[str] = ()) -> DataFrame:
    """Per reason: groups, share of all groups, and means of measures (passing groups only)."""
    r = F.coalesce(F.col("reason"), F.lit("pass"))
    g = gated.groupBy(*keys, r.alias("reason")).agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(F.when(F.col("reason").isNull(), F.col(m))), 6).alias(f"mean_{m}") for m in measures],
    )
    # one row per reason is left, so the window below is over a handful of rows
    w = Window.partitionBy(*keys)
    return g.withColumns(
        {
            "n_groups": F.sum("n").over(w),
            "pass_rate": F.round(ratio(F.sum(F.when(F.col("reason") == "pass", F.col("n")).otherwise(0)).over(w), F.sum("n").over(w)), 6),
        }
    )


def filter_members(df: DataFrame, include: dict[str, Sequence[str]], exclude: Sequence[dict[str, str]] = ()) -> DataFrame:
    """Rows whose columns take listed values, without the listed combinations."""
    for c, values in include.items():
        df = df.filter(F.col(c).isin(*values))
    for combo in exclude:
        hit = F.lit(True)
        for c, v in combo.items():
            hit = hit & F.col(c).eqNullSafe(F.lit(v))
        df = df.filter(~hit)
    return df
