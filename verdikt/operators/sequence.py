"""Step-sequence operators: neighbours, carry events, checkpoints, key frames.

Steps of a group are numbered 0, 1, 2 … without gaps.  Every window below runs inside a block of BLOCK
steps, so a group that holds a third of all rows is still spread over many tasks.  What crosses a block
border is passed on as a halo row (neighbours) or as a running total per block (as-of values).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .dims import horizon_bucket
from .joins import BLOCK, block_join, spread_join


def with_neighbour(
    df: DataFrame, cols: Mapping[str, str], offset: int, keys: Sequence[str] = ("group_id",), t: str = "t", block: int = BLOCK
) -> DataFrame:
    """Columns of the step before (offset -1) or after (+1): ``{new name: column}``."""
    blk = F.floor(F.col(t) / block).cast("bigint")
    edge = F.pmod(F.col(t), F.lit(block)) == (block - 1 if offset < 0 else 0)
    home = F.struct(blk.alias("b"), F.lit(True).alias("home"))
    halo = F.struct((blk - offset).alias("b"), F.lit(False).alias("home"))
    rows = df.withColumn("_at", F.explode(F.when(edge, F.array(home, halo)).otherwise(F.array(home))))
    w = Window.partitionBy(*keys, "_at.b").orderBy(t)
    return (
        rows.withColumns({new: F.lag(c, -offset).over(w) for new, c in cols.items()})
        .filter("_at.home")
        .drop("_at")
    )


def running_max(
    df: DataFrame, values: Mapping[str, Column], order: Sequence[str], keys: Sequence[str], t: str = "t", block: int = BLOCK
) -> DataFrame:
    """Running maximum of expressions along ``order`` (``t`` first) within ``keys``, block by block."""
    d = df.withColumns({"_blk": F.floor(F.col(t) / block).cast("bigint"), **{f"_v_{n}": v for n, v in values.items()}})
    totals = d.groupBy(*keys, "_blk").agg(*[F.max(f"_v_{n}").alias(f"_b_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_blk", *[F.max(f"_b_{n}").over(before).alias(f"_c_{n}") for n in values])
    w = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(totals, [*keys, "_blk"]).withColumns(
        {n: F.greatest(F.col(f"_c_{n}"), F.max(f"_v_{n}").over(w)) for n in values}
    )
    return out.drop("_blk", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, name: str = "idx") -> DataFrame:
    """0-based row number within ``keys``; ``bucket`` cuts the order into ranges that are numbered apart."""
    d = df.withColumn("_blk", bucket)
    sizes = d.groupBy(*keys, "_blk").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(*keys, "_blk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    return (
        d.join(start, [*keys, "_blk"])
        .withColumn(name, F.col("_start") + F.row_number().over(w) - 1)
        .drop("_blk", "_start")
    )


# ---------------------------------------------------------------- carry events


def carry_events(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """pickup, reacquire and drop events: (group_id, t, kind, label).

    Taking up a label is a reacquire if the label was taken up or dropped before; a label that changes
    while something is held is no event.
    """
    s = with_neighbour(steps.select("group_id", "t", "carry"), {"prev": "carry"}, -1, block=block)
    taken = F.col("prev").isNull() & F.col("carry").isNotNull()
    dropped = F.col("prev").isNotNull() & F.col("carry").isNull()
    raw = s.filter(taken | dropped).select(
        "group_id", "t", F.coalesce("carry", "prev").alias("label"), dropped.alias("is_drop")
    )
    first = raw.groupBy("group_id", "label").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    ev = block_join(raw, first, ["group_id", "label"], "last_t", block=block)
    kind = (
        F.when(F.col("is_drop"), F.lit("drop"))
        .when(F.col("first_t") < F.col("t"), F.lit("reacquire"))
        .otherwise(F.lit("pickup"))
    )
    return ev.select("group_id", "t", kind.alias("kind"), "label")


def carry_summary(steps: DataFrame) -> DataFrame:
    """Per group: number of steps, of steps where the carried object changed, and the last label."""
    s = with_neighbour(steps.select("group_id", "t", "carry"), {"prev": "carry"}, -1)
    return s.groupBy("group_id").agg(
        F.count("*").alias("n_steps"),
        F.sum((~F.col("carry").eqNullSafe(F.col("prev"))).cast("int")).alias("n_changes"),
        F.coalesce(F.max_by("carry", "t"), F.lit("none")).alias("terminal_label"),
    )


def first_step(cond: Column, start: Column | int = 0, t: str = "t") -> Column:
    """Aggregate: first step from ``start`` on where a condition holds; 0 if there is none."""
    return F.coalesce(F.min(F.when(cond & (F.col(t) >= start), F.col(t))), F.lit(0))


def _status() -> Column:
    """Status from the last pickup ``_p``, drop ``_d`` and reacquire ``_r`` so far."""
    p, d, r = F.col("_p"), F.col("_d"), F.col("_r")
    return (
        F.when(p.isNotNull() & r.isNotNull(), F.lit("reacquired_and_holding"))
        .when(p.isNotNull() & (d.isNull() | (d < p)), F.lit("holding"))
        .otherwise(F.lit("dropped"))
    )


def status_as_of(events: DataFrame, checkpoints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Status of a label at a checkpoint ``query_step`` from the last events up to it.

    Events and checkpoints are merged into one sequence and scanned once; there is no join on the group.
    A drop after a reacquire is not looked at.
    """
    keep = checkpoints.columns
    c = checkpoints.select(
        "group_id", "label", F.col("query_step").alias("t"), F.lit(1).alias("_q"), F.lit(None).cast("string").alias("kind"),
        F.struct(*keep).alias("_row"),
    )
    e = events.select(
        "group_id", "label", "t", F.lit(0).alias("_q"), "kind", F.lit(None).cast(c.schema["_row"].dataType).alias("_row")
    )
    at = lambda k: F.when(F.col("kind") == k, F.col("t"))
    run = running_max(
        c.unionByName(e), {"_p": at("pickup"), "_d": at("drop"), "_r": at("reacquire")}, ["t", "_q"], ["group_id", "label"], block=block
    )
    return run.filter("_q = 1").select("_row.*", _status().alias("status"))


# ---------------------------------------------------------------- checkpoints

# Checkpoint roles in order of precedence, offsets after the first pickup, frame limit.
IDENTITY_OFFSETS = {"identity_short": 1, "identity_medium": 11, "identity_long": 26}
STATUS_ROLES = ["status_early_holding", "status_mid_holding", "status_first_post_drop", "status_late_post_drop"]
MAX_FRAMES = 12


def first_pickups(steps: DataFrame, events: DataFrame, same_label_drop: bool = True) -> DataFrame:
    """Per group with a pickup: first pickup step and label, first drop, number of steps.

    ``same_label_drop`` looks for the first drop of that label, otherwise of any label.
    """
    n = steps.groupBy("group_id", "env_task").agg((F.max("t") + 1).alias("n_steps"))
    per_label = events.groupBy("group_id", "label").agg(
        F.min(F.when(F.col("kind") == "pickup", F.col("t"))).alias("p"), F.min(F.when(F.col("kind") == "drop", F.col("t"))).alias("d")
    )
    drop = F.col("_f.d") if same_label_drop else F.col("any_drop")
    g = per_label.groupBy("group_id").agg(
        F.min_by(F.struct("label", "p", "d"), F.col("p")).alias("_f"), F.min("d").alias("any_drop")
    )
    g = g.filter(F.col("_f.p").isNotNull()).select(
        "group_id", F.col("_f.label").alias("label"), F.col("_f.p").alias("pickup_step"), drop.alias("drop_step")
    )
    return n.join(g, "group_id")


def propose_checkpoints(firsts: DataFrame) -> DataFrame:
    """One row per group and role; ``query_step`` is null where the role has no candidate."""
    p, d, n = F.col("pickup_step"), F.col("drop_step"), F.col("n_steps")
    roles: list[tuple[str, str, Column]] = []
    for role, off in IDENTITY_OFFSETS.items():
        roles.append((role, "identity", F.when(p + off < n, p + off)))
    late = F.when(n - 1 == d + 1, n - 2).otherwise(n - 1)
    by_role = {
        "status_early_holding": F.when(p + 1 < n, p + 1),
        "status_mid_holding": F.when(d > p + 5, F.floor((p + d) / 2).cast("bigint")).otherwise(F.least(p + 15, n - 1)),
        "status_first_post_drop": F.when(d + 1 < n, d + 1),
        "status_late_post_drop": F.when(late > d, late),
    }
    roles += [(r, "status", by_role[r]) for r in STATUS_ROLES]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("role_rank"), F.lit(r).alias("sampling_role"), F.lit(k).alias("query_type"), q.cast("bigint").alias("query_step")
            )
            for i, (r, k, q) in enumerate(roles)
        ]
    )
    gap = F.col("query_step") - F.col("pickup_step")
    return (
        firsts.withColumn("_r", F.explode(rows))
        .select(*firsts.columns, "_r.*")
        .withColumns({"horizon_gap": gap, "horizon_bucket": F.when(gap.isNotNull(), horizon_bucket(gap))})
    )


def prefix_frames(q: Column, p: Column) -> Column:
    """Sorted frame numbers shown for a checkpoint: ends, neighbours of the pickup, and midpoints of wide gaps.

    Frame 0 and frame q are always in, so the list never needs padding at its ends.
    """
    clamp = lambda x: F.greatest(F.lit(0), F.least(q, x)).cast("bigint")
    base = F.array_sort(
        F.array_distinct(F.array(clamp(F.lit(0)), clamp(q), clamp(q - 1), clamp(p - 1), clamp(p), clamp(p + 1)))
    )
    mids = F.transform(
        base,
        lambda a, i: F.when(F.get(base, i + 1) - a > 3, F.floor((a + F.get(base, i + 1)) / 2).cast("bigint")).otherwise(a),
    )
    return F.array_sort(F.array_distinct(F.concat(base, mids)))


def status_at_few(events: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The same status for a handful of checkpoints per group: one join and one aggregation of the events.

    A group and label has a bounded number of checkpoints, so an event meets few of them.
    """
    keys = ["group_id", "label", "query_step"]
    asked = checkpoints.select(*keys).distinct()
    j = block_join(events, asked, ["group_id", "label"], "query_step").filter(F.col("t") <= F.col("query_step"))
    last = lambda k: F.max(F.when(F.col("kind") == k, F.col("t")))
    m = j.groupBy(*keys).agg(last("pickup").alias("_p"), last("drop").alias("_d"), last("reacquire").alias("_r"))
    return checkpoints.join(m, keys, "left").withColumn("status", _status()).drop("_p", "_d", "_r")


def judge_proposals(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """``decision`` per proposal: accepted, or the first reason against it.

    A status role is a duplicate only if an earlier role with the same step was itself accepted.
    """
    with_q = proposals.filter(F.col("query_step").isNotNull())
    st = status_at_few(events, with_q).withColumn("frames", prefix_frames(F.col("query_step"), F.col("pickup_step")))
    is_status = F.col("query_type") == "status"
    holding_role = is_status & F.contains(F.col("sampling_role"), F.lit("holding"))
    own = (
        F.when(holding_role & (F.col("status") != "holding"), F.lit("not_holding"))
        .when((F.size("frames") > MAX_FRAMES) | (F.col("query_step") >= F.col("n_steps")), F.lit("frame_cap"))
        .otherwise(F.lit("accepted"))
    )
    # at most seven proposals share a group
    w = Window.partitionBy("group_id", "query_type", "query_step")
    st = st.withColumn("_own", own)
    best = F.min(F.when(F.col("_own") == "accepted", F.col("role_rank"))).over(w)
    st = st.withColumn("_best", best).withColumn(
        "decision", F.when(is_status & (F.col("_best") < F.col("role_rank")), F.lit("duplicate_step")).otherwise(F.col("_own"))
    )
    answer = F.when(is_status, F.col("status")).otherwise(F.col("label"))
    none = proposals.filter(F.col("query_step").isNull()).withColumns(
        {"status": F.lit(None).cast("string"), "frames": F.lit(None).cast("array<bigint>"), "decision": F.lit("no_candidate"), "answer": F.lit(None).cast("string")}
    )
    return st.withColumn("answer", answer).drop("_own", "_best").unionByName(none)


# ---------------------------------------------------------------- transitions, regions


def transitions(steps: DataFrame, state: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(state, action, next state) rows; the last step of a group starts no transition."""
    out = with_neighbour(steps, {f"next_{c}": c for c in state} | {"_n": "t"}, +1, block=block)
    return out.filter(F.col("_n").isNotNull()).drop("_n")


def first_in_region(steps: DataFrame, region: DataFrame, cell: Sequence[str] = ("x", "y")) -> DataFrame:
    """First step of each group on a cell of its environment's target region; null if it never gets there."""
    marked = spread_join(
        steps, region.select("env_task", *cell, F.lit(True).alias("_in")).distinct(), ["env_task", *cell], F.col("t"), "left"
    )
    return marked.groupBy("group_id").agg(F.min(F.when(F.col("_in"), F.col("t"))).alias("enter_step"))


# ---------------------------------------------------------------- storyboards (one row = one trajectory)

# Action codes.
PICKUP, DROP, TOGGLE = 3, 4, 5


def seen_at(visible: Column, kind: str, start: Column) -> Column:
    """First index from ``start`` on whose visible types contain ``kind``; 0 if none."""
    hits = F.filter(F.transform(visible, lambda v, i: F.when(F.array_contains(v, kind) & (i >= start), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0))


def acted_at(actions: Column, action: int, start: Column) -> Column:
    hits = F.filter(F.transform(actions, lambda a, i: F.when((a == action) & (i >= start), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0))


def linspace_int(lo: Column, hi: Column, k: int) -> Column:
    """k evenly spaced numbers from lo to hi, cut to whole numbers; the last one is exactly hi."""
    step = (hi - lo).cast("double") / float(max(1, k - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.when((i == k - 1) & (i > 0), hi.cast("int")).otherwise((lo + i * step).cast("int")),
    )


def with_storyboard(df: DataFrame, k: int, env: str = "env_family", actions: str = "actions", visible: str = "visible", n_frames: Column | None = None) -> DataFrame:
    """``board``: k key-frame numbers of a trajectory by the rules of its environment family.

    The look-ups depend on each other, so they are added in stages and each runs once per row.
    """
    zero, a, v = F.lit(0), F.col(actions), F.col(visible)
    n = (n_frames if n_frames is not None else F.size(actions) + 1).cast("int")
    last = F.col("_last")
    after = lambda t: F.least(last, F.col(t) + 1)
    tidy = lambda *xs: F.array_sort(F.array_distinct(F.array(*[F.col(x) if isinstance(x, str) else x for x in xs])))
    d = df.withColumns(
        {
            "_last": n - 1,
            "_key": seen_at(v, "key", zero),
            "_ball": seen_at(v, "ball", zero),
            "_lava": seen_at(v, "lava", zero),
            "_door1": seen_at(v, "door", zero),
            "_pick": acted_at(a, PICKUP, zero),
            "_tog1": acted_at(a, TOGGLE, zero),
        }
    )
    d = d.withColumns(
        {
            "_cue": F.greatest("_ball", "_key"),
            "_door": seen_at(v, "door", F.col("_pick")),
            "_goal_l": seen_at(v, "goal", F.col("_lava")),
            "_goal_t": seen_at(v, "goal", F.col("_tog1")),
            "_door2": seen_at(v, "door", F.col("_tog1")),
        }
    )
    d = d.withColumns({"_tog": acted_at(a, TOGGLE, F.col("_door")), "_tog2": acted_at(a, TOGGLE, F.col("_door2"))})
    mid = F.floor((F.col("_lava") + F.col("_goal_l")) / 2).cast("int")
    recall = F.concat(F.array(zero, F.col("_cue"), last), linspace_int(F.col("_cue"), last, max(2, k - 2)))
    unlock = tidy(zero, "_key", "_pick", after("_pick"), "_door", "_tog", after("_tog"), last)
    rules = [
        ("doorkey", unlock),
        ("memory", F.array_sort(F.array_distinct(recall))),
        ("lavagap", tidy(zero, "_lava", mid, "_goal_l", last)),
        ("multiroom", tidy(zero, "_door1", "_tog1", after("_tog1"), "_goal_t", last)),
        ("keycorridor", unlock),
        ("redblue", tidy(zero, "_door1", "_tog1", after("_tog1"), "_door2", "_tog2", last)),
    ]
    raw = F.when(F.lit(False), F.array(zero))
    for name, frames in rules:
        raw = raw.when(F.contains(F.lower(F.col(env)), F.lit(name)), frames)
    d = d.withColumn("_raw", raw.otherwise(linspace_int(zero, last, k)))
    d = d.withColumn("_raw", F.when(F.size("_raw") < 2, F.array(zero, last)).otherwise(F.col("_raw")))
    picked = F.transform(
        linspace_int(zero, F.size("_raw") - 1, k), lambda i: F.greatest(zero, F.least(last, F.get(F.col("_raw"), i)))
    )
    return d.withColumn("board", F.array_sort(picked)).select(*df.columns, "board")
