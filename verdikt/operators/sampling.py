"""Seeded draws, top-k per key, stratified and quota samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import draw_key
from .gates import complete_groups

# rank limits up to this size are applied by Spark on the map side already
LIMIT_PUSHED = 1000
SALTS = 64


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key.

    For a large ``n`` a key's rows are ranked in salted parts first; each part keeps ``n`` rows, so nothing
    that belongs to the result is lost and a hot key is cut down before it meets in one task.
    """
    if n > LIMIT_PUSHED:
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*[o if isinstance(o, Column) else F.col(o) for o in order]), F.lit(SALTS)))
        df = df.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= n).drop("_salt", "_r")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def sample_groups(df: DataFrame, n: int, seed: object, env: str = "env_task", group: str = "group_id") -> DataFrame:
    """All rows of ``n`` groups per environment, drawn by seed."""
    groups = top_per_key(df.select(env, group).distinct(), [env], [draw_key(seed, env, group), group], n)
    return df.join(groups.select(env, group), [env, group], "left_semi")


def first_complete_groups(df: DataFrame, n: int, required: Sequence[str], env: str = "env_task", group: str = "group_id") -> DataFrame:
    """The first ``n`` complete groups per environment by id, with the environment's number of skipped ones."""
    g = complete_groups(df, required, [env, group])
    skipped = g.groupBy(env).agg(F.count(F.when(~F.col("complete"), 1)).alias("n_skipped"))
    picked = top_per_key(g.filter("complete"), [env], [group], n)
    return picked.select(env, group, "rank").join(skipped, env)


def round_robin_sample(df: DataFrame, n: int, seed: object, stratum: str = "env_task", uid: str = "uid", ordered: Column | None = None) -> DataFrame:
    """``n`` rows taken in turns over the strata, shuffled inside each; ``n`` <= 0 takes all rows.

    ``ordered`` takes the first ``n`` rows in that order instead.
    """
    if n <= 0:
        return df
    if ordered is not None:
        return df.orderBy(ordered).limit(n)
    s = F.coalesce(F.col(stratum), F.lit("unknown"))
    ranked = top_per_key(df.withColumn("_s", s), ["_s"], [draw_key(seed, uid), uid], n, "_turn")
    return ranked.orderBy("_turn", "_s").limit(n).drop("_turn", "_s")


def seeded_sample(df: DataFrame, n: int, seed: object, uid: str = "uid", ordered: bool = False) -> DataFrame:
    return df.orderBy(uid if ordered else draw_key(seed, uid), uid).limit(n)


def sample_steps(steps: DataFrame, k: int, seed: object, group: str = "group_id") -> DataFrame:
    """``k`` different steps of each trajectory."""
    return top_per_key(steps, [group], [draw_key(seed, group, "t"), "t"], k, "draw")


def custom_rank(column: str, order: Sequence[str]) -> Column:
    """Position in a given order; values outside it come last."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return F.when(pos > 0, pos).otherwise(len(order) + 1)


# ---------------------------------------------------------------- quota sample

QUOTA_SCHEMA = "env_task string, pick int, stage string, sampling_role string, group_id string, uid string"


def quota_sample(
    exam: DataFrame, targets: Mapping[str, int], extras: Sequence[str], total: int, prefer_long: bool = True, rank_once: bool = False
) -> DataFrame:
    """Greedy quota sample per environment, as a log of picks and missing slots.

    Role by role, a pick prefers groups not used so far, then (if asked) long horizons, then group and uid.
    Extra roles follow one by one until ``total``; a fallback by (group, uid) fills what is left.  With
    ``rank_once`` a role's rows are ranked before its first pick only, and there is no fallback.

    The greedy choice is sequential, but can only ever touch few rows: at most ``n`` groups and uids are
    used before any choice.  A pick from an unused group is among the best rows of one of the first
    ``n + 1`` groups of its role (one row per group, or as many as the role's target if ranked once).  If
    the unused groups run out, fewer rows than a target lie outside the used ones, so the pick is one of
    the first ``2 n + 1`` rows.  Spark cuts each role to those rows: one small frame per environment.
    """
    n = max(total, sum(targets.values()) + len(extras))
    per_group = max(targets.values()) if rank_once else 1
    short = (F.col("horizon_bucket") != "long").cast("int") if prefer_long else F.lit(0)
    rows = exam.select("env_task", "sampling_role", "group_id", "uid", F.coalesce(short, F.lit(1)).alias("short"))
    by_role = ["env_task", "sampling_role"]
    by_group = [*by_role, "group_id"]
    best = rows.groupBy(*by_group).agg(F.min(F.struct("short", "uid")).alias("_b"))
    best = best.select(*by_group, "_b.uid", "_b.short")
    cols = [*by_group, "uid", "short"]
    groups = top_per_key(best, by_role, ["short", "group_id", "uid"], n + 1).select(*cols)
    if per_group > 1:
        few = top_per_key(rows, by_group, ["short", "uid"], per_group).select(*cols)
        groups = few.join(groups.select(*by_group), by_group, "left_semi")
    first_rows = top_per_key(rows, by_role, ["short", "group_id", "uid"], 2 * n + 1).select(*cols)
    rest = top_per_key(rows, ["env_task"], ["group_id", "uid"], 2 * n).select(*cols)
    small = groups.unionByName(first_rows).unionByName(rest).distinct()
    plan = (list(targets.items()), list(extras), total, rank_once)
    return small.groupBy("env_task").applyInPandas(lambda pdf: greedy_picks(pdf, *plan), QUOTA_SCHEMA)


def greedy_picks(pdf: pd.DataFrame, targets: list[tuple[str, int]], extras: list[str], total: int, rank_once: bool = False) -> pd.DataFrame:
    """The sequential choice itself, over the rows of one environment."""
    env = pdf["env_task"].iloc[0]
    ranked = pdf.sort_values(["short", "group_id", "uid"])
    used_ids: set[str] = set()
    used_groups: set[str] = set()
    log: list[tuple] = []

    def take(stage: str, role: str, k: int = 1) -> None:
        rows = ranked[(ranked["sampling_role"] == role) & ~ranked["uid"].isin(used_ids)]
        old = rows["group_id"].isin(used_groups)
        picks = pd.concat([rows[~old], rows[old]]).head(k)
        for r in picks.itertuples():
            used_ids.add(r.uid)
            used_groups.add(r.group_id)
            log.append((env, len(used_ids), stage, role, r.group_id, r.uid))
        log.extend([(env, -1, f"missing_{stage}", role, None, None)] * (k - len(picks)))

    for role, k in targets:
        if rank_once:
            take("base", role, k)
            continue
        for _ in range(k):
            take("base", role)
    for role in extras:
        if len(used_ids) < total:
            take("extra", role)
    if not rank_once:
        for r in pdf.sort_values(["group_id", "uid"]).itertuples():
            if len(used_ids) >= total:
                break
            if r.uid not in used_ids:
                used_ids.add(r.uid)
                log.append((env, len(used_ids), "fallback", r.sampling_role, r.group_id, r.uid))
    return pd.DataFrame(log, columns=["env_task", "pick", "stage", "sampling_role", "group_id", "uid"])
