"""Composition reports and build manifests of exam tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def distribution(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Row counts of several breakdowns in one pass: ``breakdown``, the columns (null if not in it), ``n``."""
    dims = list(dict.fromkeys(d for s in sets for d in s))
    ids = [sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s) for s in sets]
    g = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("_gid"), F.count("*").alias("n")
    )
    label = F.lit(None).cast("string")
    for i, s in zip(ids, sets):
        label = F.when(F.col("_gid") == i, F.lit("+".join(s) or "all")).otherwise(label)
    return g.select(label.alias("breakdown"), *dims, "n")


def composition(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts of every value of every dimension as rows, for the cover of a review pack."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    return df.select(pairs.alias("p")).groupBy("p.dim", "p.value").agg(F.count("*").alias("n"))


def manifest_rows(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], **config: str) -> DataFrame:
    """The manifest as rows that can be written beside a build: settings, counts and distributions, as (section, key, value)."""
    head = manifest(df, dims, **config)
    facts = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in head.columns]))
    shown = distribution(df, sets)
    names = list(dict.fromkeys(d for s in sets for d in s))
    keyed = shown.select(F.col("breakdown").alias("section"), F.concat_ws("|", *names).alias("key"), F.col("n").cast("string").alias("value"))
    return head.select(F.lit("build").alias("section"), facts.alias("f")).select("section", "f.*").unionByName(keyed)


def manifest(df: DataFrame, dims: Sequence[str], **config: str) -> DataFrame:
    """One row about a build: its settings, row count, and number of different values per dimension."""
    counts = [F.count_distinct(d).alias(f"n_{d}") for d in dims]
    return df.agg(F.count("*").alias("n_rows"), *counts).select(*[F.lit(v).alias(k) for k, v in config.items()], "*")
