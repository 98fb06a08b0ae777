"""Whole runs: a crawl, then re-runs of what failed until that stops helping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from midyear.config import CrawlConfig
from midyear.operators.errors import error_counts, homepages_to_retry, is_retriable_page, pages_to_retry
from midyear.operators.merge import (
    clear_homepage_errors,
    clear_page_errors,
    is_homepage_error,
    merge_homepage_errors,
    merge_page_errors,
    merge_pages,
)
from midyear.plans.crawl import Crawl, crawl_homepages, crawl_located, fetch_homepages, locate
from midyear.plans.single_page import SinglePages, single_pages
from midyear.plans.walk import readable_homepage
from midyear.session import cut_lineage, store
from midyear.sources.captures import Archive


@dataclass
class Collection:
    """Errors so far, and the page writes not yet merged.

    Only errors steer a run, so they are merged pass by pass; they carry no
    text. Page writes wait in a list and meet the page table once, at the end.
    """

    errors: DataFrame
    page_writes: list[DataFrame] = field(default_factory=list)
    homepage_counts: list[int] = field(default_factory=list)
    page_counts: list[int] = field(default_factory=list)
    failed: tuple[int, int] | None = None

    @property
    def next_batch(self) -> int:
        return len(self.page_writes)

    def pages(self, existing: DataFrame) -> DataFrame:
        """The page table after all writes."""
        if not self.page_writes:
            return existing
        return merge_pages(existing, reduce(DataFrame.unionByName, self.page_writes))

    def keep(self, errors: DataFrame) -> None:
        """The error table after a pass; what is to be tried again is counted as it is stored."""
        seen = Observation()
        self.errors = cut_lineage(errors.observe(
            seen, F.count_if(is_homepage_error()).alias("homepages"), F.count_if(is_retriable_page()).alias("pages")
        ))
        self.failed = seen.get["homepages"], seen.get["pages"]

    def count_failed(self) -> tuple[int, int]:
        """Homepages and pages to try again."""
        if self.failed is None:
            counts = {r.kind: r.n for r in error_counts(self.errors).collect()}
            self.failed = counts["homepage"], counts["page"]
        return self.failed


def _writes(rows: DataFrame, shape: str, batch: int) -> DataFrame:
    # Keys are unique within a pass but for pages reached under two numbers; the later one stays.
    number = "n_page_downloaded" if "n_page_downloaded" in rows.columns else "Depth"
    return rows.select(
        "*",
        F.lit(shape).alias("write_shape"),
        F.lit(batch).alias("batch_no"),
        F.coalesce(number, F.lit(0)).alias("seq"),
    )


def add_crawl(collection: Collection, done: Crawl) -> None:
    done = done.stored()
    batch = collection.next_batch
    errors = clear_homepage_errors(collection.errors, done.scraped)
    errors = merge_homepage_errors(errors, _writes(done.homepage_errors, "homepage", batch))
    errors = merge_page_errors(errors, _writes(done.page_errors, "walk", batch))
    collection.keep(errors)
    collection.page_writes.append(_writes(done.pages, "walk", batch))


def add_single_pages(collection: Collection, done: SinglePages) -> None:
    done = done.stored()
    batch = collection.next_batch
    errors = clear_page_errors(collection.errors, done.opened)
    errors = merge_page_errors(errors, _writes(done.errors, "single", batch))
    collection.keep(errors)
    collection.page_writes.append(_writes(done.pages, "single", batch))


def _until_stable(count: Callable[[], int], again: Callable[[int], None], counts: list[int]) -> None:
    """Repeat while there are failures and their number still changes."""
    before, rounds = 0, 0
    while True:
        now = count()
        counts.append(now)
        if now in (0, before):
            return
        again(rounds)
        before, rounds = now, rounds + 1


def changed_homepages(homepages: DataFrame, errors: DataFrame) -> DataFrame:
    """Visits of failed homepages that came out otherwise than the error table says."""
    known = errors.where(is_homepage_error()).select(
        "website", "year_query", F.col("original_query_URL_wayback_machine").alias("known_url"),
        F.col("error_message").alias("known_message"),
    )
    same = F.col("known_url").eqNullSafe(F.coalesce("capture_url", "query_url")) & F.col("known_message").eqNullSafe(F.col("error"))
    return homepages.join(known, ["website", "year_query"], "left").where(~F.coalesce(same, F.lit(False))).select(*homepages.columns)


def rerun_homepages(collection: Collection, archives: Sequence[Archive], config: CrawlConfig) -> None:
    """Crawl failed sites again; round ``i`` fetches from ``archives[i]``, the last one repeating.

    A round works on what changed: an archive that has been tried already changes nothing,
    and from another one only sites whose homepage comes out otherwise go on to the walk
    and the tables. What is left out would be written as it stands, but for its time.
    """
    tried: list[Archive] = []

    def again(rounds: int) -> None:
        archive = archives[min(rounds, len(archives) - 1)]
        if any(archive is other for other in tried):
            return
        tried[:] = [archive]
        seeds = homepages_to_retry(collection.errors)
        located = store(locate(seeds, archive), "capture_url")
        visits = fetch_homepages(located.rows, archive.responses_of(located.keys, config.broadcast_bytes))
        found = store(changed_homepages(visits, collection.errors), "capture_url", F.col("error").isNull() & readable_homepage())
        if found.count:
            add_crawl(collection, crawl_homepages(found, archive, config))

    _until_stable(lambda: collection.count_failed()[0], again, collection.homepage_counts)


def rerun_pages(collection: Collection, archives: Sequence[Archive], config: CrawlConfig) -> None:
    """Fetch failed pages again, as ``rerun_homepages`` does sites: only those that come out otherwise are worked on."""
    tried: list[Archive] = []

    def again(rounds: int) -> None:
        archive = archives[min(rounds, len(archives) - 1)]
        if any(archive is other for other in tried):
            return
        tried[:] = [archive]
        # Rows without both URLs cannot be fetched; they keep their error.
        rows = pages_to_retry(collection.errors, "error_message", "nretries_link").where(
            "original_url is not null and processed_url is not null"
        )
        done = single_pages(rows, archive, config, changed_only=True)
        if done:
            add_single_pages(collection, done)

    _until_stable(lambda: collection.count_failed()[1], again, collection.page_counts)


def run(
    seeds: DataFrame,
    archives: Sequence[Archive],
    errors: DataFrame,
    config: CrawlConfig = CrawlConfig(),
) -> Collection:
    """Crawl from ``archives[0]``; re-runs go on with the archives after it.

    errors: the error table before the run.
    """
    return run_located(locate(seeds, archives[0]), archives, errors, config)


def run_located(
    located: DataFrame,
    archives: Sequence[Archive],
    errors: DataFrame,
    config: CrawlConfig = CrawlConfig(),
) -> Collection:
    """As ``run``, from seeds whose homepages are located already."""
    later = archives[1:] or archives
    collection = Collection(errors)
    add_crawl(collection, crawl_located(located, archives[0], config))
    rerun_homepages(collection, later, config)
    rerun_pages(collection, later, config)
    return collection
