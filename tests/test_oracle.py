"""Every registered query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest
from oracle import all_sql

from tests.conftest import SF_DIR
from verdikt.plans.check import compare
from verdikt.plans.registry import all_queries

# queries of the optional subpackage are tested beside it
QUERIES = all_queries()
ORACLE = all_sql()
# every query has SQL
WITHOUT_SQL: set[str] = set()


def test_every_query_has_sql():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(set(QUERIES)))
def test_query(spark, name):
    result = compare(spark, SF_DIR, QUERIES, ORACLE, [name])[name]
    assert result.startswith(("ok", "rows-only")), result


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["level", "model"] and df.count() > 0
