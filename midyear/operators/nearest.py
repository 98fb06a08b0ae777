"""Capture nearest to mid-year, per site and year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def capture_ends(captures: DataFrame) -> DataFrame:
    """(website, span, first, last): the first and the last capture of a site between two mid-years.

    Only these can be nearest to a mid-year. ``last`` holds the time negated, so that
    the lower URL is the smaller one of a tie. captures: site, url, captured_at.
    """
    at = F.unix_timestamp("captured_at")
    # Years run from mid-year to mid-year.
    span = F.year("captured_at") - (F.month("captured_at") < 7).cast("int")
    return _ends(captures.select(
        F.col("site").alias("website"),
        span.alias("span"),
        F.struct(at.alias("at"), "url").alias("first"),
        F.struct((-at).alias("back"), "url").alias("last"),
    ))


def _ends(rows: DataFrame) -> DataFrame:
    return rows.groupBy("website", "span").agg(F.min("first").alias("first"), F.min("last").alias("last"))


def merge_ends(*ends: DataFrame) -> DataFrame:
    """The ends of all captures, from those of parts of them: an index that grows by what is added."""
    return _ends(reduce(DataFrame.unionByName, ends))


def nearest_capture(seeds: DataFrame, captures: DataFrame) -> DataFrame:
    """As-of join, nearest in either direction; ties go to the earlier capture, then the lower URL.

    Captures shrink to two per site and year before they are shuffled, however many
    a site has. The join then meets a handful of rows per site.

    seeds: website, year_query. captures: site, url, captured_at.
    """
    return nearest_end(seeds, capture_ends(captures))


def nearest_end(seeds: DataFrame, ends: DataFrame) -> DataFrame:
    """As ``nearest_capture``, from ``capture_ends``."""
    target = F.unix_timestamp(F.make_date("year_query", F.lit(7), F.lit(1)).cast("timestamp"))
    after = F.col("span") >= F.col("year_query")
    at = F.when(after, F.col("first.at")).otherwise(-F.col("last.back"))
    url = F.when(after, F.col("first.url")).otherwise(F.col("last.url"))
    candidates = seeds.distinct().join(ends, "website").select(
        "website",
        "year_query",
        F.struct(F.abs(at - target).alias("distance"), at.alias("at"), url.alias("url")).alias("c"),
    )
    return (
        candidates.groupBy("website", "year_query")
        .agg(F.min("c").alias("c"))
        .select(
            "website",
            "year_query",
            F.col("c.url").alias("capture_url"),
            F.timestamp_seconds(F.col("c.at")).alias("captured_at"),
        )
    )
