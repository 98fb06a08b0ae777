"""Text lists of seeds and of pages to fetch again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from midyear import constants as K
from midyear.functions.urls import without_blanks
from midyear.session import cut_lineage

SEPARATOR = ", "


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): the lines of one or several files in order, from 0; files follow each other by path.

    Lines are counted per block of a file, and a line's number is the lines of the
    blocks before plus its place in the block, so no task holds more than its blocks.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block")
    # Stored, so that a line keeps its place when it is read again.
    lines = cut_lineage(spark.read.text(path).select("value", place, F.monotonically_increasing_id().alias("at")))
    blocks = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    starts = blocks.select("block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = lines.join(F.broadcast(starts), "block")
    return numbered.select("value", (F.col("start") + F.col("at") - F.col("first")).alias("line_no"))


def first_listed(lines: DataFrame) -> DataFrame:
    """(website, year_query, line_no) of numbered lines: every seed once, where it first stands."""
    return parse_seeds(lines).groupBy("website", "year_query").agg(F.min("line_no").alias("line_no"))


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(
        *lines.columns, F.split(F.btrim("value", F.lit(K.BLANKS)), SEPARATOR, -1).alias("f")
    )


def _field(number: int) -> Column:
    return F.get("f", F.lit(number))


def _seed_fields(lines: DataFrame) -> DataFrame:
    return _fields(lines).select(
        *lines.columns,
        _field(0).alias("website"),
        _field(1).try_cast("int").alias("year_query"),
        (F.size("f") == 2).alias("complete"),
    )


def parse_seeds(lines: DataFrame) -> DataFrame:
    """(website, year_query) of well-formed lines, and their line_no if they have one."""
    return _seed_fields(lines).where("complete and year_query is not null").drop("complete", "value")


def bad_seed_lines(lines: DataFrame) -> DataFrame:
    return _seed_fields(lines).where("not (complete and year_query is not null)").select("value")


def _page_fields(lines: DataFrame) -> DataFrame:
    return _fields(lines).select(
        "value",
        _field(0).alias("website"),
        _field(1).try_cast("int").alias("year_query"),
        _field(2).alias("original_url"),
        _field(3).alias("processed_url"),
        _field(4).try_cast("int").alias("depth"),
        (F.size("f") == 5).alias("complete"),
    )


_PAGE_OK = "complete and year_query is not null and depth is not null"


def parse_retry_pages(lines: DataFrame) -> DataFrame:
    """(website, year_query, original_url, processed_url, depth) of well-formed lines."""
    return _page_fields(lines).where(_PAGE_OK).drop("complete", "value")


def bad_retry_lines(lines: DataFrame) -> DataFrame:
    return _page_fields(lines).where(f"not ({_PAGE_OK})").select("value")


def seed_lines(seeds: DataFrame) -> DataFrame:
    return seeds.select(
        F.concat("website", F.lit(SEPARATOR), F.col("year_query").cast("string")).alias("value")
    )


def retry_page_lines(rows: DataFrame) -> DataFrame:
    """One line per page; rows without both URLs have none (see ``rows_without_url``)."""
    return rows.where("original_url is not null and processed_url is not null").select(
        F.concat_ws(
            SEPARATOR,
            "website",
            F.col("year_query").cast("string"),
            without_blanks(F.col("original_url")),
            without_blanks(F.col("processed_url")),
            F.col("depth").cast("string"),
        ).alias("value")
    )


def rows_without_url(rows: DataFrame) -> DataFrame:
    return rows.where("original_url is null or processed_url is null")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)
