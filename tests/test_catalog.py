"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import compare
import pytest

from ragstone.plans import registry as catalog


@pytest.fixture(scope="module")
def con(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, data, con, name):
    assert compare.differences(catalog.QUERIES[name](spark, data), con, catalog.ORACLE_SQL[name]) == []


def test_queries_without_sql_have_plain_programs():
    text = (Path(__file__).parent / "test_brute.py").read_text()
    assert all(name in text for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "corpus_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
