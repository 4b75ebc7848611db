"""The entry points with and without the optional text operators."""

import importlib
import sys

import pytest

import __spark_entry__ as entry_points


def without(monkeypatch, module):
    monkeypatch.setitem(sys.modules, module, None)
    try:
        return importlib.reload(entry_points)
    finally:
        monkeypatch.undo()


def test_claims_queries_stand_alone(monkeypatch):
    alone = without(monkeypatch, "corpus_pipeline")
    assert set(alone.queries()) == set(alone.oracle_sql()) and "age_sex_case_control" in alone.queries()
    assert not any(name.startswith("op") or name == "pipeline" for name in alone.queries())
    importlib.reload(entry_points)


def test_other_import_errors_are_not_swallowed(monkeypatch):
    with pytest.raises(ModuleNotFoundError):
        without(monkeypatch, "prevalo.catalogue.oracle")
    importlib.reload(entry_points)


def test_every_check_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
