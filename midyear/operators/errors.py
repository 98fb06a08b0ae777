"""Which failures to fetch again, and how complete a collection is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from midyear import constants as K
from midyear.operators.merge import is_homepage_error


def homepages_to_retry(errors: DataFrame) -> DataFrame:
    """(website, year_query) of sites never entered."""
    return errors.where(is_homepage_error()).select("website", "year_query")


def is_retriable_page() -> Column:
    """A failed link page of depth 1 that another attempt may open.

    Pages without text and pages answered with 40x are left alone; a missing
    message or flag passes.
    """
    message = F.col("error_message")
    return (
        ~message.eqNullSafe(K.NO_TEXT_MESSAGE)
        & ~F.coalesce(message.rlike(K.PERMANENT_STATUS), F.lit(False))
        & F.col("website_not_scrapped").isNull()
        & F.coalesce(F.col("Depth") == 1, F.lit(False))
    )


def pages_to_retry(errors: DataFrame, *more: str) -> DataFrame:
    return errors.where(is_retriable_page()).select(
        "website",
        "year_query",
        F.col("original_query_URL_wayback_machine").alias("original_url"),
        F.col("URL_wayback_machine_processed").alias("processed_url"),
        F.col("Depth").alias("depth"),
        *more,
    )


def error_counts(errors: DataFrame) -> DataFrame:
    """Rows to retry of either kind, counted in one pass."""
    counts = errors.agg(
        F.count_if(is_homepage_error()).alias("homepage"), F.count_if(is_retriable_page()).alias("page")
    )
    return counts.select(
        F.inline(F.array(*(
            F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("n")) for kind in ("homepage", "page")
        )))
    )


def site_years(rows: DataFrame) -> DataFrame:
    return rows.select("website", "year_query").distinct()


def not_downloaded(errors: DataFrame, pages: DataFrame) -> DataFrame:
    """Errors whose page has not been stored since."""
    key = ["website", "year_query", "URL_wayback_machine_processed"]
    return errors.join(pages.select(*key).distinct(), key, "left_anti").select(*errors.columns)


def coverage(seeds: DataFrame, pages: DataFrame, errors: DataFrame) -> DataFrame:
    """Per seed: stored pages, errors, and one status.

    ``downloaded``: has pages. ``not_scraped``: its homepage failed. ``empty``:
    entered, but only failures came of it. ``missing``: no trace of it.
    """
    keys = ["website", "year_query"]
    stored = pages.groupBy(*keys).agg(F.count("*").alias("n_pages"))
    failed = errors.groupBy(*keys).agg(
        F.count("*").alias("n_errors"), F.count_if(is_homepage_error()).alias("n_homepage_errors")
    )
    n_pages = F.coalesce("n_pages", F.lit(0))
    n_errors = F.coalesce("n_errors", F.lit(0))
    return (
        seeds.distinct().join(stored, keys, "left").join(failed, keys, "left")
        .select(
            *keys,
            n_pages.alias("n_pages"),
            n_errors.alias("n_errors"),
            F.when(n_pages > 0, "downloaded")
            .when(F.coalesce("n_homepage_errors", F.lit(0)) > 0, "not_scraped")
            .when(n_errors > 0, "empty")
            .otherwise("missing").alias("status"),
        )
    )
