"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest
from check import compare, connect

from trailmark.plans.registry import load_all

REGISTRY = load_all()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(name, spark, sf_dir, db):
    query = REGISTRY[name]
    df = query(spark, sf_dir)
    rows = df.collect()
    if query.sql is None:
        assert df.columns
        return
    result = db.execute(query.sql)
    problem = compare(df.columns, rows, [d[0] for d in result.description], result.fetchall())
    assert problem is None, problem


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
