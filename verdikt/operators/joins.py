"""Deduplication and the joins between exams, responses and each other.

Keys that may be hot (one uid answered again and again, one group with most of the steps) are reduced by
partial aggregation before they are shuffled, or joined through ``spread_join``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import stable_int

SPREAD = 16
BLOCK = 4096


def _pick(df: DataFrame, keys: Sequence[str], order: str | Column, largest: bool, keep_order: bool = True) -> DataFrame:
    """One row per key.  min_by/max_by combine on the map side, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys and (keep_order or c != order)]
    order = F.col(order) if isinstance(order, str) else order
    fn = F.max_by if largest else F.min_by
    picked = df.groupBy(*keys).agg(fn(F.struct(*rest), order).alias("_r"), F.count("*").alias("n_copies"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest], "n_copies")


def first_per_key(df: DataFrame, keys: Sequence[str], order: str | Column, keep_order: bool = True) -> DataFrame:
    """First row per key in ``order`` plus ``n_copies``, the number of rows it stands for.

    Without ``keep_order`` the column ``order`` is left out; a wide one then travels once, not twice.
    """
    return _pick(df, keys, order, False, keep_order)


def last_per_key(df: DataFrame, keys: Sequence[str], order: str | Column, keep_order: bool = True) -> DataFrame:
    return _pick(df, keys, order, True, keep_order)


def spread_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Column, how: str = "inner", n: int = SPREAD
) -> DataFrame:
    """Join a fact table to a table of dimension size (environments, files, cells) over a hot key.

    Rows of the big side get one of ``n`` salts from ``spread_by``; the small side is repeated per salt.
    """
    b = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(n)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return b.join(s, [*keys, "_salt"], how).drop("_salt")


def block_join(
    steps: DataFrame, facts: DataFrame, keys: Sequence[str], last_t: str | Column, how: str = "inner", t: str = "t", block: int = BLOCK
) -> DataFrame:
    """Join steps to facts about their group, block by block.

    ``last_t`` is the last step that needs the fact; the fact is repeated for the blocks up to it.  That is
    one copy for a group of normal length, and a hot group is dealt out over its blocks.
    """
    last_t = F.col(last_t) if isinstance(last_t, str) else last_t
    b = steps.withColumn("_blk", F.floor(F.col(t) / block).cast("bigint"))
    f = facts.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last_t / block).cast("bigint"))))
    return b.join(f, [*keys, "_blk"], how).drop("_blk")


def models_table(gold: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every gold row once per model; the list of models is a parameter, not data."""
    return gold.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def gold_left_join(gold: DataFrame, responses: DataFrame, models: Sequence[str]) -> DataFrame:
    """Each gold uid and model with its response, if there is one (``answered``)."""
    resp = responses.withColumn("answered", F.lit(True))
    out = models_table(gold, models).join(resp, ["uid", "model"], "left")
    return out.withColumn("answered", F.coalesce("answered", F.lit(False)))


def _with_picked(gold: DataFrame, responses: DataFrame, models: Sequence[str], order: str, keep: str) -> DataFrame:
    """Gold with the first (or last) response of each model i as ``_r{i}`` and their number as ``_n{i}``; gold is dealt once for all models.

    A uid's responses become one row with a struct per model, so neither gold nor uid is shuffled and sorted once per model.
    """
    fn = F.min_by if keep == "first" else F.max_by
    rest = [c for c in responses.columns if c not in ("uid", "model")]
    ours = lambda m, c: F.when(F.col("model") == m, c)
    made = lambda i, m: [fn(ours(m, F.struct(*rest)), ours(m, F.col(order))).alias(f"_r{i}"), F.count(ours(m, F.lit(1))).alias(f"_n{i}")]
    by_uid = responses.filter(F.col("model").isin(*models)).groupBy("uid").agg(*[c for i, m in enumerate(models) for c in made(i, m)])
    return gold.join(by_uid, "uid", "left")


def _copies(i: int) -> list[Column]:
    n = F.coalesce(f"_n{i}", F.lit(0))
    return [F.when(n > 0, n).alias("n_copies"), (n > 0).alias("answered")]


def picked_left_join(gold: DataFrame, responses: DataFrame, models: Sequence[str], order: str, keep: str = "first") -> DataFrame:
    """``gold_left_join`` with the first (or last) response per uid and model; gold is dealt once for all models."""
    rest = [c for c in responses.columns if c not in ("uid", "model")]
    out = _with_picked(gold, responses, models, order, keep)
    each = [F.struct(F.lit(m).alias("model"), F.col(f"_r{i}").alias("r"), *_copies(i)) for i, m in enumerate(models)]
    out = out.select(*gold.columns, F.explode(F.array(*each)).alias("_m"))
    others = [F.col(c) for c in gold.columns if c != "uid"]
    return out.select("uid", F.col("_m.model").alias("model"), *others, *[F.col("_m.r")[c].alias(c) for c in rest], "_m.n_copies", "_m.answered")


def answers_left_join(gold: DataFrame, responses: DataFrame, models: Sequence[str], order: str, answer: str, keep: str = "first") -> DataFrame:
    """``picked_left_join`` with one row for each *different* answer of a uid, so that what judges share is read once.

    ``_by`` lists the models that gave the answer, with the other columns of their responses; ``each_model`` makes their rows of it.
    No response and a null answer count as one answer.
    """
    rest = [c for c in responses.columns if c not in ("uid", "model", answer)]
    out = _with_picked(gold, responses, models, order, keep)
    said = [F.col(f"_r{i}")[answer] for i in range(len(models))]
    # the first model with the same answer speaks for all that gave it
    first = lambda i: F.coalesce(*[F.when(said[j].eqNullSafe(said[i]), F.lit(j)) for j in range(i)], F.lit(i))
    out = out.withColumns({f"_f{i}": first(i) for i in range(len(models))})
    info = lambda i: F.struct(F.lit(models[i]).alias("model"), *[F.col(f"_r{i}")[c].alias(c) for c in rest], *_copies(i))
    with_i = lambda i: F.array(*[F.when(F.col(f"_f{j}") == i, info(j)) for j in range(i, len(models))])
    slots = [F.when(F.col(f"_f{i}") == i, F.struct(said[i].alias(answer), with_i(i).alias("_by"))) for i in range(len(models))]
    out = out.select(*gold.columns, F.explode(F.array(*slots)).alias("_s")).filter(F.col("_s").isNotNull())
    return out.select(*gold.columns, f"_s.{answer}", "_s._by")


def each_model(df: DataFrame) -> DataFrame:
    """The rows of ``answers_left_join`` once for each model that gave the answer."""
    out = df.withColumn("_m", F.explode("_by")).filter(F.col("_m").isNotNull()).drop("_by")
    return out.select("*", "_m.*").drop("_m")


def extra_responses(gold: DataFrame, responses: DataFrame, n: int | None = 50) -> DataFrame:
    """Answered uids that no exam knows; ``n`` bounds the listing, not the check."""
    extra = responses.select("uid").distinct().join(gold.select("uid"), "uid", "left_anti")
    return extra.orderBy("uid").limit(n) if n else extra


def unanswered(requests: DataFrame, log: DataFrame, keys: Sequence[str] = ("uid",), retry_errors: bool = False) -> DataFrame:
    """Requests still to be sent.  An error counts as an answer unless ``retry_errors`` is set."""
    done = log.filter(F.col("ok")) if retry_errors else log
    return requests.join(done.select(*keys).distinct(), list(keys), "left_anti")


def shard(df: DataFrame, n: int, k: int, key: str = "uid") -> DataFrame:
    """The k-th of n hash shards of the rows; the hash is one that other engines have as well."""
    return df.filter(F.pmod(stable_int(F.col(key).cast("string")), F.lit(n)) == k)


def representation_pairs(responses: DataFrame, left: str, right: str, value: Column, by: str = "model") -> DataFrame:
    """Answers of two representations side by side, for uids that have both; one shuffle, no self-join."""
    both = (
        responses.filter(F.col(by).isin(left, right))
        .groupBy("uid")
        .agg(
            F.max(F.when(F.col(by) == left, value)).alias("left_value"),
            F.max(F.when(F.col(by) == right, value)).alias("right_value"),
            F.max((F.col(by) == left).cast("int")).alias("_l"),
            F.max((F.col(by) == right).cast("int")).alias("_r"),
        )
    )
    return both.filter((F.col("_l") == 1) & (F.col("_r") == 1)).drop("_l", "_r")


def pivot_variants(
    df: DataFrame, keys: Sequence[str], variants: Sequence[str], fields: Sequence[str], order: str | Column, others: str | None = None
) -> DataFrame:
    """Variants of a group in one row as structs; the last record of a variant wins.

    ``others`` names a column for the number of records of variants that were not asked for.
    """
    order = F.col(order) if isinstance(order, str) else order
    rec = F.struct(*fields)
    return df.groupBy(*keys).agg(
        *[F.max_by(F.when(F.col("variant") == v, rec), F.when(F.col("variant") == v, order)).alias(v) for v in variants],
        *([F.count_if(~F.coalesce(F.col("variant").isin(*variants), F.lit(False))).alias(others)] if others else []),
    )


def pair_table(df: DataFrame, dims: Sequence[str], side: str, sides: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Pairs such as orig/rev or full/cf as one row per remaining dimensions: ``<value>_<side>`` columns."""
    return (
        df.filter(F.col(side).isin(*sides))
        .groupBy(*dims)
        .agg(*[F.max(F.when(F.col(side) == s, F.col(v))).alias(f"{v}_{s}") for v in values for s in sides])
    )


def repair(df: DataFrame, patch: DataFrame, fields: Sequence[str], key: str = "uid") -> DataFrame:
    """Override fields from a patch table and say where each row comes from."""
    p = patch.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields], F.lit(True).alias("_hit"))
    out = df.join(p, key, "left")
    hit = F.col("_hit").isNotNull()
    return out.withColumns(
        {f: F.when(hit, F.col(f"_p_{f}")).otherwise(F.col(f)) for f in fields}
        | {"provenance": F.when(hit, F.lit("replaced")).otherwise(F.lit("kept"))}
    ).drop("_hit", *[f"_p_{f}" for f in fields])


def patch_subset(df: DataFrame, where: Column, changes: dict[str, Column]) -> DataFrame:
    """Change columns of the rows that match; all others stay as they are."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) if c in df.columns else F.when(where, v) for c, v in changes.items()})


def with_lookup(df: DataFrame, key: str, ranks: Sequence[tuple[str, str, int]], default_rank: int = 9) -> DataFrame:
    """Display name and rank of a value from a fixed list; unknown values keep their name and sort last."""
    names = F.create_map(*[F.lit(x) for k, name, _ in ranks for x in (k, name)])
    order = F.create_map(*[F.lit(x) for k, _, r in ranks for x in (k, r)])
    return df.withColumns(
        {
            f"{key}_name": F.coalesce(F.try_element_at(names, F.col(key)), F.col(key)),
            f"{key}_rank": F.coalesce(F.try_element_at(order, F.col(key)), F.lit(default_rank)),
        }
    )


def main_table(*parts: DataFrame, on: Sequence[str] = ("model",)) -> DataFrame:
    """Model-level tables side by side; a model missing in one of them keeps its row."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(on), "full")
    return out
