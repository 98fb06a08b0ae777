"""Runs from paths to paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from midyear.config import CrawlConfig
from midyear.operators.errors import homepages_to_retry, pages_to_retry
from midyear.plans.crawl import locate_by_answers
from midyear.plans.runs import Collection, add_single_pages, run, run_located
from midyear.plans.single_page import single_pages
from midyear.sources.captures import Archive, open_archive
from midyear.sources.lists import (
    bad_retry_lines,
    bad_seed_lines,
    parse_retry_pages,
    parse_seeds,
    read_lines,
    retry_page_lines,
    rows_without_url,
    seed_lines,
    write_lines,
)
from midyear.sources.tables import empty_errors, empty_pages, read_answers, read_errors, read_pages, write_table


def _archives(spark: SparkSession, paths: Sequence[str], config: CrawlConfig) -> list[Archive]:
    return [open_archive(spark, path, config.attempts) for path in paths]


def _errors(spark: SparkSession, path: str | None) -> DataFrame:
    return read_errors(spark, path) if path else empty_errors(spark)


def _write(spark: SparkSession, done: Collection, output: str, pages: str | None) -> None:
    """``output``/pages and /errors; what is still to fetch as lists in /retry_homepages and /retry_pages.

    Failed pages that lack a URL have no line in a list; they go to /retry_without_url.
    """
    write_table(done.pages(read_pages(spark, pages) if pages else empty_pages(spark)), f"{output}/pages")
    write_table(done.errors, f"{output}/errors")
    failed = pages_to_retry(done.errors)
    write_lines(seed_lines(homepages_to_retry(done.errors)), f"{output}/retry_homepages")
    write_lines(retry_page_lines(failed), f"{output}/retry_pages")
    write_table(rows_without_url(failed), f"{output}/retry_without_url")


def run_job(
    spark: SparkSession,
    seed_list: str,
    archives: Sequence[str],
    output: str,
    pages: str | None = None,
    errors: str | None = None,
    config: CrawlConfig = CrawlConfig(),
) -> Collection:
    """Crawl the seeds of a text list; write ``output``/pages, /errors, the retry lists and /bad_seeds.

    ``archives`` are paths of captures, stored archives or logs of fetch attempts:
    the first serves the crawl, the others the re-runs in turn. ``pages`` and ``errors`` are tables of
    an earlier run to go on from; they are read, not changed.
    """
    lines = read_lines(spark, seed_list)
    done = run(parse_seeds(lines).distinct(), _archives(spark, archives, config), _errors(spark, errors), config)
    _write(spark, done, output, pages)
    write_lines(bad_seed_lines(lines), f"{output}/bad_seeds")
    return done


def run_answers_job(
    spark: SparkSession,
    answers: str,
    archives: Sequence[str],
    output: str,
    pages: str | None = None,
    errors: str | None = None,
    config: CrawlConfig = CrawlConfig(),
) -> Collection:
    """As ``run_job``, with the first homepages named by a table of availability answers."""
    located = locate_by_answers(read_answers(spark, answers))
    done = run_located(located, _archives(spark, archives, config), _errors(spark, errors), config)
    _write(spark, done, output, pages)
    return done


def run_pages_job(
    spark: SparkSession,
    page_list: str,
    archive: str,
    output: str,
    pages: str | None = None,
    errors: str | None = None,
    config: CrawlConfig = CrawlConfig(),
) -> Collection:
    """Fetch the pages of a text list once; write what ``run_job`` does, and /bad_lines."""
    lines = read_lines(spark, page_list)
    done = Collection(_errors(spark, errors))
    rows = parse_retry_pages(lines).distinct()
    add_single_pages(done, single_pages(rows, _archives(spark, [archive], config)[0], config))
    _write(spark, done, output, pages)
    write_lines(bad_retry_lines(lines), f"{output}/bad_lines")
    return done
