"""From the links of opened pages to the URLs a walk fetches next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from midyear.functions.binding import computed
from midyear.functions.urls import is_eligible, resolve_href, url_key

SITE = ["website", "year_query"]


def candidate_links(parents: DataFrame, links: DataFrame, year_range: int) -> DataFrame:
    """Eligible links of ``parents`` with their keys; no link is fetched to be judged.

    parents: website, year_query, url, position, n_retries_api.
    links: url, href.
    """
    return (
        parents.join(links, "url")
        .select(
            *SITE,
            "position",
            "n_retries_api",
            computed(resolve_href(F.col("href"), F.col("website"))).alias("link"),
        )
        .where(is_eligible(F.col("link"), F.col("website"), F.col("year_query"), year_range))
        .select("*", computed(url_key(F.col("link"), F.col("website"))).alias("url_key"))
    )


def first_per_key(candidates: DataFrame) -> DataFrame:
    """The first link of each key per site and year, by parent position, then URL.

    An aggregation, so repeated links collapse before the shuffle.
    """
    return (
        candidates.groupBy(*SITE, "url_key")
        .agg(
            F.min(F.struct("position", "link")).alias("first"),
            F.min("taken").alias("taken"),
            F.min("n_retries_api").alias("n_retries_api"),
        )
        .select(*SITE, "url_key", "first.position", "first.link", "taken", "n_retries_api")
    )


def not_visited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """visited: website, year_query, url_key."""
    return frontier.join(visited, [*SITE, "url_key"], "left_anti")


def within_quota(frontier: DataFrame, page_limit: int) -> DataFrame:
    """Number the links of each site and year; keep numbers up to ``page_limit + 1``.

    ``taken`` numbers are already used up by shallower levels. The literal
    bound lets each task drop, before the shuffle, what cannot be kept.
    """
    in_order = Window.partitionBy(*SITE).orderBy("position", "link")
    return (
        frontier.withColumn("rank", F.row_number().over(in_order))
        .where((F.col("rank") <= page_limit + 1) & (F.col("taken") + F.col("rank") <= page_limit + 1))
        .withColumn("n_page", (F.col("taken") + F.col("rank")).cast("int"))
        .drop("rank")
    )


def next_links(candidates: DataFrame, visited: DataFrame, page_limit: int) -> DataFrame:
    """``first_per_key``, ``not_visited`` and ``within_quota`` of a level in one shuffle.

    Candidates and what was visited meet by site and year; there they are reduced to one
    row per key, visited keys say which numbers are used up and drop out, and the
    others are numbered. Of a site and year that is what so many opened pages link to
    as the quota admits.

    candidates: website, year_query, url_key, position, link, n_retries_api.
    visited: website, year_query, url_key, n_page.
    """
    found = candidates.select(
        *SITE, "url_key", F.struct("position", "link").alias("first"), "n_retries_api", F.lit(None).cast("int").alias("n_page")
    )
    used = visited.select(
        *SITE, "url_key", F.lit(None).cast(found.schema["first"].dataType).alias("first"),
        F.lit(None).cast("int").alias("n_retries_api"), "n_page",
    )
    keys = found.unionByName(used).repartition(*SITE).groupBy(*SITE, "url_key").agg(
        F.min("first").alias("first"), F.min("n_retries_api").alias("n_retries_api"), F.max("n_page").alias("seen")
    )
    site = Window.partitionBy(*SITE)
    fresh = keys.withColumn("taken", F.coalesce(F.max("seen").over(site), F.lit(0))).where("seen is null")
    number = F.col("taken") + F.row_number().over(site.orderBy("first"))
    return fresh.select(*SITE, "url_key", "first.position", "first.link", "n_retries_api", number.cast("int").alias("n_page")).where(
        F.col("n_page") <= page_limit + 1
    )
