"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import DATA
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    problem, _, _, _ = compare(spark, db, DATA, queries()[name], SQL.get(name))
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_has_a_query_for_each_key():
    assert set(SQL) <= set(queries())
