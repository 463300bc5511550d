"""Every registered query that has SQL gives the same rows on DuckDB."""

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, sf_dir, con, name):
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], sf_dir) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_gives_segments(spark):
    rows = entry(spark).collect()
    assert rows and sum(row["count"] for row in rows) == 150
