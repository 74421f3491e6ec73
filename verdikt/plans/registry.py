"""Collects the registered queries: name → DataFrame builder over ``Fixtures``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}


def query(name: str):
    def add(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        return fn

    return add


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import load_all

    load_all()
    bind = lambda fn: lambda spark, sf_dir: fn(fixtures(spark, sf_dir))
    return {name: bind(fn) for name, fn in QUERIES.items()}


_FIXTURES: dict[tuple[str, str], Fixtures] = {}


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    """The views of a folder, analysed once per application (they are plans, no data is kept)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixtures(spark, sf_dir)
    return _FIXTURES[key]
