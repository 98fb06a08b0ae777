"""Run registered queries next to their SQL and compare rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.sql("set timezone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


def rows_of_sql(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = connection.sql(sql)
    names = sorted(result.columns)
    order = [result.columns.index(n) for n in names]
    return names, Counter(tuple(row[i] for i in order) for row in result.fetchall())


def rows_of_spark(query, spark: SparkSession, sf_dir: str) -> tuple[list[str], Counter]:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    return names, Counter(tuple(row[n] for n in names) for row in df.collect())
