"""The parts of operators that SQL can say, against DuckDB."""

from __future__ import annotations

import pytest

from framewright.llm import queries

from ..compare import duck, rows_of


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_part(spark, sf, name):
    df, cur = queries.queries()[name](spark, sf), duck(sf).execute(queries.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
