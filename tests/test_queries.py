import pytest

import __spark_entry__ as entry
from palimpsest.plans.queries import ORACLES, QUERIES
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_part(monkeypatch):
    """The other queries stay when the training-data part is not there."""
    import importlib
    import sys

    for name in ("corpus_pipeline", "palimpsest.llm"):
        monkeypatch.setitem(sys.modules, name, None)
    for name in [m for m in sys.modules if m.startswith("palimpsest.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    bare = importlib.reload(entry)
    assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(ORACLES)
    monkeypatch.undo()
    importlib.reload(entry)
