import importlib
import sys

import __spark_entry__


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(__spark_entry__)
    assert bare.queries() and not any(q.startswith("op") or q == "pipeline" for q in bare.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
