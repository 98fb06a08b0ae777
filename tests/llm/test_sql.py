"""Quality rules against their SQL where many cutoffs are certified: the fixture has too few labels for the usual risk."""

import importlib

import pytest

from midyear.llm import quality, sql
from midyear.llm.queries import QUERIES
from verification.compare import duck, rows_of_spark, rows_of_sql


@pytest.fixture
def lenient(monkeypatch):
    monkeypatch.setattr(quality, "RISK", 0.6)
    monkeypatch.setattr(quality, "HARM", 0.25)
    yield importlib.reload(sql).QUALITY
    monkeypatch.undo()
    importlib.reload(sql)


def test_certified_cutoffs_equal_sql(spark, lenient):
    folder = "/root/testdata/sf0.01"
    found = rows_of_spark(QUERIES["op9_quality_rules"], spark, folder)
    names, rows = found
    failed, kept = names.index("base_failed"), names.index("kept")
    assert any(not row[failed] and not row[kept] for row in rows)
    assert found == rows_of_sql(duck(folder), lenient)
