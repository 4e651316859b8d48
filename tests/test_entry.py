import sys

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_the_rest_stands_without_the_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries()
    monkeypatch.setitem(sys.modules, "sectora.llm", None)
    assert not any(q.startswith("op") for q in entry.queries()) and "iot_leontief" in entry.oracle_sql()
