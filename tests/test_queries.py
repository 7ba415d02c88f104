"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from framewright import plans  # noqa: F401
from framewright.catalog import ORACLES, QUERIES

from .compare import duck, rows_of


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_a_text():
    assert all(f.__doc__ for f in QUERIES.values())
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns and df.limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
