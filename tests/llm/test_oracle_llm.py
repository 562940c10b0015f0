"""Queries of the subpackage against their SQL; the others run."""

import pytest

from quillspan.llm import queries as q
from tests.conftest import rows

SQL = q.oracle_sql()
#: Queries that find nothing in tables as small as these.
SPARSE = {"p2_chunks"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_oracle(spark, sf, duck, name):
    a, b = q.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    df = q.queries()[name](spark, sf)
    assert df.columns and (df.count() > 0 or name in SPARSE)
