"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from compare import compare

import __spark_entry__ as contract

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    database = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return database


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_twin(spark, connection, sf_dir, name):
    result = compare(spark, connection, sf_dir, name, QUERIES[name], SQL.get(name))
    assert result.startswith(("ok", "rows-only")), result
    assert " 0 rows" not in result


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0
