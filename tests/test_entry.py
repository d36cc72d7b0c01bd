"""The entry points stand without the training-data package and without what it imports."""

import importlib
import sys

import pytest


@pytest.mark.parametrize("absent", ["zstandard", "public_tokenizers", "emberline.llm", "corpus_pipeline"])
def test_library_queries_survive_an_absent_module(monkeypatch, absent):
    for name in list(sys.modules):
        if name in ("__spark_entry__", "corpus_pipeline") or name.startswith("emberline.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "fleet_health" in names and not any(n.startswith("op") and "_" in n and n[2:].split("_")[0].isdigit() for n in names)
    assert set(entry.oracle_sql()) <= names
    monkeypatch.delitem(sys.modules, "__spark_entry__")
