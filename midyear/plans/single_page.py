"""Another attempt at single pages that failed before; their links are not followed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from midyear.config import CrawlConfig
from midyear.functions import urls as U
from midyear.functions.outcomes import content_error, page_error
from midyear.plans.walk import is_opened, with_text
from midyear.schemas import ERRORS, PAGES
from midyear.session import cut_lineage, store
from midyear.sources.captures import Archive


@dataclass(frozen=True)
class SinglePages:
    """Rows of one pass. ``opened`` lists the page-error keys that answered."""

    outcomes: DataFrame
    opened: DataFrame

    @property
    def pages(self) -> DataFrame:
        """Page writes of shape ``single``.

        Keys, time and redirection come from the URLs of the list, not from the
        response. Fields the shape does not set are null.
        """
        processed = F.col("processed_url")
        return self.outcomes.where("error is null").select(
            "website",
            U.url_key(processed, F.col("website")).alias("downloaded_link"),
            "year_query",
            F.col("original_url").alias("original_query_URL_wayback_machine"),
            processed.alias("URL_wayback_machine_processed"),
            F.lit(None).cast("int").alias("n_page_downloaded"),
            F.coalesce("title", F.lit("")).alias("Title_page"),
            F.col("text").alias("TextContent"),
            U.capture_time_text(processed).alias("snapshot_date_string"),
            U.snapshot_date(processed).alias("snapshot_date"),
            F.year(U.snapshot_date(processed)).alias("year_obtained"),
            (F.col("original_url") != processed).alias("Redirected"),
            F.col("depth").alias("Depth"),
            F.lit(None).cast("int").alias("n_retries_api"),
            F.col("n_retries").alias("nretries_link"),
            F.current_timestamp().alias("lastModified"),
        ).select(*PAGES.fieldNames())

    @property
    def errors(self) -> DataFrame:
        """Page-error writes of shape ``single``."""
        return self.outcomes.where("error is not null").select(
            "website",
            "year_query",
            F.col("original_url").alias("original_query_URL_wayback_machine"),
            F.col("processed_url").alias("URL_wayback_machine_processed"),
            F.col("depth").alias("Depth"),
            F.col("error").alias("error_message"),
            F.lit(None).cast("boolean").alias("website_not_scrapped"),
            F.lit(None).cast("boolean").alias("Redirected"),
            F.lit(None).cast("int").alias("n_retries_api"),
            F.col("n_retries").alias("nretries_link"),
            F.current_timestamp().alias("lastModified"),
        ).select(*ERRORS.fieldNames())

    def stored(self) -> SinglePages:
        return SinglePages(cut_lineage(self.outcomes), self.opened)


def fetch_pages(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses of listed pages, fetched by processed URL.

    ``failure`` is set unless the page answered; ``error`` also covers an answer
    that is not text.
    """
    status, final = F.col("status"), F.col("final_url")
    return (
        rows.withColumn("url", F.col("processed_url"))
        .join(responses, "url", "left")
        .withColumn("n_retries", F.coalesce("n_retries", F.lit(0)))
        .withColumn("failure", page_error(status, final, F.col("transport_error")))
        .withColumn("error", F.coalesce("failure", content_error(status, final, F.col("content_type"))))
    )


def single_pages(
    rows: DataFrame, archive: Archive, config: CrawlConfig = CrawlConfig(), changed_only: bool = False
) -> SinglePages | None:
    """rows: website, year_query, original_url, processed_url, depth.

    ``changed_only``: rows also have the error_message and nretries_link of the failure
    they come from; rows that fail as before are left out, and without others there is no result.
    """
    rows = store(rows, "processed_url")
    responses = archive.responses_of(rows.keys, config.broadcast_bytes)
    fetched = fetch_pages(rows.rows, responses)
    if changed_only:
        same = F.col("error").eqNullSafe(F.col("error_message")) & F.col("n_retries").eqNullSafe(F.col("nretries_link"))
        fetched = fetched.where(~same | F.col("error").isNull()).drop("error_message", "nretries_link")
    fetched = store(fetched, "url", is_opened())
    if changed_only and not fetched.count:
        return None
    opened = fetched.rows.where("failure is null").select(
        "website",
        "year_query",
        F.col("original_url").alias("original_query_URL_wayback_machine"),
        F.col("processed_url").alias("URL_wayback_machine_processed"),
    )
    return SinglePages(with_text(fetched, archive, config), opened)
