"""Every core query with SQL agrees with the oracle; the others run and give their columns."""

import pytest

from quillspan.plans import catalog
from tests.conftest import rows

SQL = catalog.oracle_sql()
#: Queries that find nothing in tables as small as these.
SPARSE = {"forward_notes", "link_topk_all", "title_pairs"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_oracle(spark, sf, duck, name):
    a, b = catalog.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert df.columns and (df.count() > 0 or name in SPARSE)


def test_entry_module_without_subpackage(spark, monkeypatch):
    import builtins
    import importlib

    real = builtins.__import__

    def without(name, *a, **k):
        if name.startswith("quillspan.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.queries())
