"""Every core query with a SQL twin against DuckDB, the others for running and giving named columns."""

import pytest

from flipgraph.plans import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns)) > 0
    df.collect()


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
