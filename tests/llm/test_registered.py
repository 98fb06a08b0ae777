"""The registered queries of the subpackage, and those with SQL against it."""

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from midyear.llm.queries import ORACLE, QUERIES
from verification.compare import duck, rows_of_spark, rows_of_sql


def test_all_registered():
    assert set(QUERIES) <= set(registered.queries()) and set(ORACLE) <= set(registered.oracle_sql())
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES} - {"pipeline"}
    assert QUERIES["pipeline"] is corpus_pipeline.run and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, tiny, name):
    assert rows_of_spark(registered.queries()[name], spark, tiny) == rows_of_sql(duck(tiny), ORACLE[name])
