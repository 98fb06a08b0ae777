"""The page table and the error table on shared storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from midyear.config import CrawlConfig
from midyear.operators.merge import merge_pages
from midyear.schemas import ANSWERS, ERRORS, PAGES
from midyear.session import cut_lineage

PARTS = ["year_query", "site_part"]
SITE_PARTS = 32
_BY_PART = T.StructType([*PAGES.fields, T.StructField("site_part", T.IntegerType())])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ERRORS).parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Stored availability answers: website, year_query, body."""
    return spark.read.schema(ANSWERS).parquet(path)


def write_table(table: DataFrame, path: str) -> None:
    """Write a merged table to a *new* path; the caller then points readers at it.

    A merge reads the old table, so the old path is never written over.
    """
    table.write.mode("errorifexists").parquet(path)


def _part() -> Column:
    return F.pmod(F.xxhash64("website"), F.lit(SITE_PARTS)).cast("int").alias("site_part")


def write_pages_by_part(table: DataFrame, path: str) -> None:
    """Write a page table to a new path in parts by year and site, for ``update_pages``."""
    table.select("*", _part()).write.mode("errorifexists").partitionBy(*PARTS).parquet(path)


def read_pages_by_part(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BY_PART).parquet(path)


def update_pages(spark: SparkSession, path: str, writes: DataFrame, config: CrawlConfig = CrawlConfig()) -> None:
    """Upsert ``writes`` (as for ``merge_pages``) into a page table in parts, in place.

    Only the parts that the writes touch are read, and replaced when all of them are
    written; the others stay as they are. Writing again what was written changes nothing.
    """
    touched: dict[int | None, list[int]] = {}
    for row in writes.select("year_query", _part()).distinct().collect():  # at most years times SITE_PARTS
        touched.setdefault(row.year_query, []).append(row.site_part)
    if not touched:
        return
    concerned = reduce(
        lambda a, b: a | b,
        (F.col("year_query").eqNullSafe(F.lit(year)) & F.col("site_part").isin(parts) for year, parts in touched.items()),
    )
    existing = read_pages_by_part(spark, path).where(concerned).select(*PAGES.fieldNames())
    # Stored first: a part must not be replaced while it may still have to be read again.
    merged = cut_lineage(merge_pages(existing, writes, config.broadcast_bytes))
    by_part = merged.select("*", _part()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    by_part.partitionBy(*PARTS).parquet(path)


def empty_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PAGES)


def empty_errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ERRORS)
