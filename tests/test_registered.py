"""Every registered query against its SQL, and the shape of the larger plans."""

import pytest

import __spark_entry__ as registered
from verification import registry
from verification.compare import duck, rows_of_spark, rows_of_sql

from .plans import moved_columns

QUERIES = {name: query for name, query in registered.queries().items() if name in registry.QUERIES}
ORACLE = {name: sql for name, sql in registered.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection(tiny):
    return duck(tiny)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, connection, tiny, name):
    assert rows_of_spark(QUERIES[name], spark, tiny) == rows_of_sql(connection, ORACLE[name])


SHAPED = ["frontier_depth1", "fetched_links", "nearest_captures", "quota", "coverage", "homepage_pages", "crawl_pages",
          "crawl_depth2", "crawl_errors", "crawl_stored_archive", "single_page_pass", "merge_pages"]


@pytest.mark.parametrize("name", SHAPED)
def test_no_pairing_and_no_page_bodies_in_exchanges(spark, tiny, name):
    rows = QUERIES[name](spark, tiny)
    assert not moved_columns(rows) & {"html", "text", "TextContent"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    rows = registered.entry(spark)
    assert rows.count() > 0 and "TextContent" in rows.columns
