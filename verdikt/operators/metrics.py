"""Paired diagnostics over score rows: order, intervention, framing, representation, degeneracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import n_where, ratio
from .joins import pair_table


def temporal_ratio(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """P(correct | orig) / P(correct | rev); null where nothing is correct in reverse."""
    acc = lambda s: F.avg(F.when(F.col("temporal") == s, F.col("correct").cast("double")))
    return scored.groupBy(*keys).agg(
        F.round(acc("orig"), 6).alias("acc_orig"),
        F.round(acc("rev"), 6).alias("acc_rev"),
        F.round(ratio(acc("orig"), acc("rev")), 6).alias("les_t"),
    )


def temporal_consistency(scored: DataFrame, dims: Sequence[str], keys: Sequence[str] = ("model",)) -> DataFrame:
    """Both published readings: the accuracy ratio, and the share of orig/rev pairs with the same verdict."""
    pairs = pair_table(
        scored.withColumn("hit", F.col("correct").cast("int")), [*keys, *dims], "temporal", ["orig", "rev"], ["hit", "verdict"]
    )
    both = F.col("verdict_orig").isNotNull() & F.col("verdict_rev").isNotNull()
    return pairs.groupBy(*keys).agg(
        F.round(ratio(F.avg("hit_orig"), F.avg("hit_rev")), 6).alias("jcr_ratio"),
        n_where(both).alias("n_pairs"),
        F.round(ratio(n_where(both & (F.col("verdict_orig") == F.col("verdict_rev"))), n_where(both)), 6).alias("jcr_pair"),
    )


def intervention_rate(scored: DataFrame, dims: Sequence[str], keys: Sequence[str] = ("model",)) -> DataFrame:
    """Full/cf pairs: share judged Success then Fail, and share of right cf verdicts where full was right."""
    pairs = pair_table(
        scored.withColumn("hit", F.col("correct").cast("int")), [*keys, *dims], "variant", ["full", "cf"], ["hit", "verdict"]
    )
    pair = F.col("hit_full").isNotNull() & F.col("hit_cf").isNotNull()
    caught = pair & (F.col("verdict_full") == "Success") & (F.col("verdict_cf") == "Fail")
    full_ok = pair & (F.col("hit_full") == 1)
    return pairs.groupBy(*keys).agg(
        n_where(pair).alias("n_pairs"),
        F.round(ratio(n_where(caught), n_where(pair)), 6).alias("idr"),
        F.round(ratio(n_where(full_ok & (F.col("hit_cf") == 1)), n_where(full_ok)), 6).alias("idr_cond"),
    )


def neutral_accuracy(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Share of cf/nocue trials judged Fail, and accuracy under the neutral framing."""
    trials = F.col("variant").isin("cf", "nocue")
    neu = F.col("framing") == "neu"
    return scored.groupBy(*keys).agg(
        F.round(ratio(n_where(trials & (F.col("verdict") == "Fail")), n_where(trials)), 6).alias("jacc_fail"),
        F.round(ratio(n_where(neu & F.col("correct")), n_where(neu)), 6).alias("jacc_neutral"),
    )


def degenerate(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Whether a judge gives one verdict to everything it answers."""
    lo, hi = F.min("verdict"), F.max("verdict")
    return scored.groupBy(*keys).agg(
        F.count("verdict").alias("n_valid"),
        F.when((lo == hi) & (lo == "Fail"), F.lit("all_fail"))
        .when((lo == hi) & (lo == "Success"), F.lit("all_success"))
        .otherwise(F.lit("none"))
        .alias("degenerate"),
    )


def agreement(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """P(same verdict | both valid) over rows with ``left_value`` and ``right_value``."""
    both = F.col("left_value").isNotNull() & F.col("right_value").isNotNull()
    return pairs.groupBy(*keys).agg(
        n_where(both).alias("n_pairs"),
        F.round(ratio(n_where(both & (F.col("left_value") == F.col("right_value"))), n_where(both)), 6).alias("vcc"),
    )


def paired_delta(pairs: DataFrame, before: str, after: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy change of paired rows with McNemar's counts and statistic (null without discordant pairs)."""
    x, y = F.col(before).cast("int"), F.col(after).cast("int")
    b, c = n_where((x == 1) & (y == 0)), n_where((x == 0) & (y == 1))
    d = (F.abs(b - c) - 1).cast("double")
    return pairs.filter(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_pairs"),
        F.round(F.avg(y) - F.avg(x), 6).alias("delta_acc"),
        b.alias("b"),
        c.alias("c"),
        F.round(ratio(d * d, b + c), 6).alias("mcnemar"),
    )
