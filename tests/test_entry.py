import importlib
import sys

import pytest


def test_without_the_training_data_part(monkeypatch):
    """The entry imports and keeps its other queries when that part has been deleted."""
    for name in [m for m in sys.modules if m.startswith(("tidemark.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "latest_scored" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    monkeypatch.delitem(sys.modules, "__spark_entry__")


TABLES = "/root/testdata/sf0.001"


def _names():
    from tidemark.plans import evaluated, ledger, live, relational, scored, selected, series, statements, textual  # noqa: F401
    from tidemark.plans.base import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", _names())
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    from tidemark.plans.base import ORACLES, QUERIES

    con = duckdb.connect()
    for t in os.listdir(TABLES):
        con.sql(f"create view {t.split('.')[0]} as select * from '{TABLES}/{t}'")
    want = con.sql(ORACLES[name])
    cols = sorted(want.columns)
    df = QUERIES[name](spark, TABLES)
    assert sorted(df.columns) == cols
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(map(show, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(show, r)) for r in want.select(*cols).fetchall())
