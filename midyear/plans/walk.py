"""The walk of a site, level by level, and what comes of every visited URL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from midyear import constants as K
from midyear.config import CrawlConfig
from midyear.functions import urls as U
from midyear.functions.outcomes import content_error, link_error
from midyear.operators.frontier import SITE, candidate_links, next_links
from midyear.schemas import ERRORS, PAGES
from midyear.session import Keys, Stored, store
from midyear.sources.captures import Archive

VISIT = [
    "website", "year_query", "depth", "n_page", "url", "original_url", "status", "transport_error",
    "final_url", "content_type", "n_redirects", "nretries_link", "n_retries_api", "error",
]


def homepage_visits(homepages: DataFrame) -> DataFrame:
    """Level 0: homepages that answered. They are stored under their final URL.

    homepages: website, year_query and the columns of RESPONSES, one row per site and year.
    """
    return homepages.select(
        *SITE,
        F.lit(0).alias("depth"),
        F.lit(0).alias("n_page"),
        "url",
        F.col("final_url").alias("original_url"),
        "status",
        "transport_error",
        "final_url",
        "content_type",
        "n_redirects",
        F.lit(0).alias("nretries_link"),
        F.col("n_retries").alias("n_retries_api"),
        content_error(F.col("status"), F.col("final_url"), F.col("content_type")).alias("error"),
    )


def fetch_links(frontier: DataFrame, responses: DataFrame, depth: int, strict_status: bool = False) -> DataFrame:
    """Responses of the URLs of a frontier; a URL without one is a failure."""
    response = responses.withColumnRenamed("url", "link")
    return frontier.join(response, "link", "left").select(
        *SITE,
        F.lit(depth).alias("depth"),
        "n_page",
        F.col("link").alias("url"),
        F.col("link").alias("original_url"),
        "status",
        "transport_error",
        "final_url",
        "content_type",
        "n_redirects",
        F.coalesce("n_retries", F.lit(0)).alias("nretries_link"),
        "n_retries_api",
        link_error(
            F.col("status"), F.col("final_url"), F.col("transport_error"), F.col("content_type"), strict_status
        ).alias("error"),
    )


def _parents(level: DataFrame) -> DataFrame:
    """Opened pages of a level."""
    return level.where("error is null").select(*SITE, "url", F.col("n_page").alias("position"), "n_retries_api")


def is_opened() -> Column:
    return F.col("error").isNull()


def readable_homepage() -> Column:
    return content_error(F.col("status"), F.col("final_url"), F.col("content_type")).isNull()


def first_level(homepages: DataFrame, opened: Keys) -> Stored:
    """Level 0, out of stored homepages; ``opened`` are the URLs of those that are readable, as counted when they were stored."""
    return Stored(homepage_visits(homepages).select(*VISIT), opened.count, opened)


def visited_homepages(level: DataFrame) -> DataFrame:
    """Keys of level 0 that are not fetched again, with their page number."""
    return level.select(*SITE, F.col("final_url").alias("url_key"), "n_page")


def next_frontier(level: Stored, visited: DataFrame, archive: Archive, config: CrawlConfig) -> Stored:
    """Links of a level to be fetched; what they ask for is counted as they are stored."""
    links = archive.links_of(level.keys, config.broadcast_bytes)
    candidates = candidate_links(_parents(level.rows), links, config.year_range)
    return store(next_links(candidates, visited, config.page_limit), "link")


def fetch_level(frontier: Stored, archive: Archive, depth: int, config: CrawlConfig) -> Stored:
    """Visits of a frontier."""
    responses = archive.responses_of(frontier.keys, config.broadcast_bytes)
    visits = fetch_links(frontier.rows, responses, depth, config.strict_status)
    return store(visits.select(*VISIT), "url", is_opened())


def walk(level: Stored, archive: Archive, config: CrawlConfig) -> Stored:
    """Visits (columns VISIT) of a breadth-first walk from the homepages of level 0.

    Rows carry URLs and numbers only; HTML and text stay out of every shuffle
    of the walk. Each level is computed once and stored, so the plan of the next
    one starts from it; its size is counted by the same action.
    """
    levels, visited = [level], visited_homepages(level.rows)
    for depth in range(1, config.depth + 1):
        if not level.keys.count:
            break
        frontier = next_frontier(level, visited, archive, config)
        if not frontier.count:
            break
        level = fetch_level(frontier, archive, depth, config)
        levels.append(level)
        visited = visited.unionByName(frontier.rows.select(*SITE, "url_key", "n_page"))
    return Stored(
        reduce(DataFrame.unionByName, [x.rows for x in levels]),
        sum(x.count for x in levels),
        reduce(Keys.__add__, [x.keys for x in levels]),
    )


def with_text(visits: Stored, archive: Archive, config: CrawlConfig) -> DataFrame:
    """Visits with title and text; an opened page without text becomes an error."""
    failed = visits.rows.where(~is_opened()).withColumns({c: F.lit(None).cast("string") for c in ("title", "text")})
    if not visits.keys.count:
        return failed
    opened = archive.with_texts(visits.rows.where(is_opened()), visits.keys, config.broadcast_bytes)
    empty = F.when(F.coalesce("text", F.lit("")) == "", K.NO_TEXT_MESSAGE)
    return opened.withColumn("error", empty).unionByName(failed)


def processed_url(final_url: Column, status: Column, requested: Column) -> Column:
    """The final URL of a response; without one, the requested URL."""
    return F.when(status.isNotNull(), final_url).otherwise(requested)


def pages_of(outcomes: DataFrame) -> DataFrame:
    """Page writes (shape ``walk``) of ``with_text``."""
    final = F.col("final_url")
    return outcomes.where("error is null").select(
        "website",
        U.url_key(final, F.col("website")).alias("downloaded_link"),
        "year_query",
        F.col("original_url").alias("original_query_URL_wayback_machine"),
        final.alias("URL_wayback_machine_processed"),
        F.col("n_page").alias("n_page_downloaded"),
        F.coalesce("title", F.lit("")).alias("Title_page"),
        F.col("text").alias("TextContent"),
        U.capture_time_text(final).alias("snapshot_date_string"),
        U.snapshot_date(final).alias("snapshot_date"),
        F.year(U.snapshot_date(final)).alias("year_obtained"),
        (F.col("n_redirects") > 0).alias("Redirected"),
        F.col("depth").alias("Depth"),
        "n_retries_api",
        "nretries_link",
        F.current_timestamp().alias("lastModified"),
    ).select(*PAGES.fieldNames())


def page_errors_of(outcomes: DataFrame) -> DataFrame:
    """Page-error writes (shape ``walk``) of ``with_text``."""
    return outcomes.where("error is not null").select(
        "website",
        "year_query",
        F.col("original_url").alias("original_query_URL_wayback_machine"),
        processed_url(F.col("final_url"), F.col("status"), F.col("original_url")).alias(
            "URL_wayback_machine_processed"
        ),
        F.col("depth").alias("Depth"),
        F.col("error").alias("error_message"),
        F.lit(None).cast("boolean").alias("website_not_scrapped"),
        (F.col("status").isNotNull() & (F.coalesce("n_redirects", F.lit(0)) > 0)).alias("Redirected"),
        "n_retries_api",
        "nretries_link",
        F.current_timestamp().alias("lastModified"),
    ).select(*ERRORS.fieldNames())
