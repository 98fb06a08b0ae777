"""From seeds to pages and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from midyear.config import CrawlConfig
from midyear.functions import outcomes as O
from midyear.functions.urls import availability_url
from midyear.plans.walk import first_level, page_errors_of, pages_of, readable_homepage, walk, with_text
from midyear.schemas import ERRORS, RESPONSES
from midyear.session import Stored, cut_lineage, store
from midyear.sources.captures import Archive

# What the availability service answers for a site it does not know.
NO_ANSWER = '{"archived_snapshots": {}}'


@dataclass(frozen=True)
class Crawl:
    """Rows of one pass. ``outcomes`` holds pages and page errors alike."""

    outcomes: DataFrame
    homepage_errors: DataFrame
    scraped: DataFrame

    @property
    def pages(self) -> DataFrame:
        return pages_of(self.outcomes)

    @property
    def page_errors(self) -> DataFrame:
        return page_errors_of(self.outcomes)

    @property
    def errors(self) -> DataFrame:
        return self.homepage_errors.unionByName(self.page_errors)

    def stored(self) -> Crawl:
        """Computed once, texts included, for use as pages and as errors."""
        return Crawl(cut_lineage(self.outcomes), self.homepage_errors, self.scraped)


def locate(seeds: DataFrame, archive: Archive) -> DataFrame:
    """Seeds with the URL of the nearest capture, or with an error."""
    located = seeds.distinct().join(archive.nearest(seeds), ["website", "year_query"], "left")
    return _with_answer(located.withColumn("body", F.lit(NO_ANSWER)), F.col("capture_url"))


def locate_by_answers(answers: DataFrame) -> DataFrame:
    """As ``locate``, from stored availability answers (website, year_query, body)."""
    return _with_answer(answers, O.answer_url(F.col("body")))


def _with_answer(seeds: DataFrame, url) -> DataFrame:
    query = availability_url(F.col("website"), F.col("year_query"))
    return seeds.select(
        "website",
        "year_query",
        url.alias("capture_url"),
        query.alias("query_url"),
        F.when(url.isNull(), O.answer_error(F.col("body"), F.col("website"), query)).alias("answer_error"),
    )


def fetch_homepages(located: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses of located homepages with ``error`` set unless they answered."""
    response = responses.withColumnRenamed("url", "capture_url")
    failure = O.homepage_error(F.col("status"), F.col("final_url"), F.col("transport_error"))
    return located.join(response, "capture_url", "left").withColumn(
        "error", F.coalesce("answer_error", failure)
    )


def homepage_errors_of(homepages: DataFrame) -> DataFrame:
    absent = {
        "URL_wayback_machine_processed": "string", "Redirected": "boolean",
        "n_retries_api": "int", "nretries_link": "int",
    }
    return homepages.where("error is not null").select(
        "website",
        "year_query",
        F.coalesce("capture_url", "query_url").alias("original_query_URL_wayback_machine"),
        F.lit(0).alias("Depth"),
        F.col("error").alias("error_message"),
        F.lit(True).alias("website_not_scrapped"),
        F.current_timestamp().alias("lastModified"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in absent.items()),
    ).select(*ERRORS.fieldNames())


def visit_homepages(located: DataFrame, archive: Archive, config: CrawlConfig) -> Stored:
    """Responses of all located homepages; those that were opened and hold text are what the walk asks for."""
    located = store(located, "capture_url")
    visits = fetch_homepages(located.rows, archive.responses_of(located.keys, config.broadcast_bytes))
    return store(visits, "capture_url", F.col("error").isNull() & readable_homepage())


def opened_homepages(homepages: DataFrame) -> DataFrame:
    return homepages.where("error is null").withColumnRenamed("capture_url", "url").select(
        "website", "year_query", *RESPONSES.fieldNames()
    )


def crawl_homepages(homepages: Stored, archive: Archive, config: CrawlConfig) -> Crawl:
    """The walks from homepages that have been visited."""
    opened = opened_homepages(homepages.rows)
    visits = walk(first_level(opened, homepages.keys), archive, config)
    return Crawl(
        outcomes=with_text(visits, archive, config),
        homepage_errors=homepage_errors_of(homepages.rows),
        scraped=opened.select("website", "year_query"),
    )


def crawl_located(located: DataFrame, archive: Archive, config: CrawlConfig) -> Crawl:
    return crawl_homepages(visit_homepages(located, archive, config), archive, config)


def crawl(seeds: DataFrame, archive: Archive, config: CrawlConfig = CrawlConfig()) -> Crawl:
    """Nearest capture, homepage, links level by level, texts."""
    return crawl_located(locate(seeds, archive), archive, config)
