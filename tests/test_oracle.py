"""Every registered query against DuckDB on the driver's smallest tables."""
import pytest

import __spark_entry__ as entry
from compare import connect, differences

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect()


def test_entry_returns_months(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "month" and df.count() == 80
