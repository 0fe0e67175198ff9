"""The driver contract holds with and without the subpackage for training data."""

import sys

import pytest

import __spark_entry__ as entry
from quadrille import catalog


def without(monkeypatch, *names):
    for name in [m for m in sys.modules if m.startswith(("quadrille.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    for name in names:
        monkeypatch.setitem(sys.modules, name, None)


@pytest.mark.parametrize("gone", [("quadrille.llm",), ("quadrille.llm", "corpus_pipeline")])
def test_queries_without_the_subpackage(monkeypatch, gone):
    without(monkeypatch, *gone)
    assert entry.queries() == catalog.QUERIES
    assert entry.oracle_sql() == catalog.ORACLE_SQL


def test_other_import_errors_are_raised(monkeypatch):
    import quadrille

    monkeypatch.delattr(quadrille, "catalog")
    monkeypatch.setitem(sys.modules, "quadrille.catalog", None)
    with pytest.raises(ImportError):
        entry.queries()


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
