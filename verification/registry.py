"""The registered queries: each runs one operator or plan over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from midyear import CrawlConfig, cut_lineage
from midyear.functions import html as H
from midyear.functions import outcomes as O
from midyear.functions import urls as U
from midyear.functions.binding import computed
from midyear.operators import errors as E
from midyear.operators import frontier as R
from midyear.operators import merge as M
from midyear.operators.attempts import compacted, resolve_attempts, resolve_rounds
from midyear.operators.nearest import capture_ends, merge_ends, nearest_capture, nearest_end
from midyear.plans.crawl import (
    crawl,
    crawl_located,
    homepage_errors_of,
    locate,
    locate_by_answers,
    opened_homepages,
    visit_homepages,
)
from midyear.plans.runs import Collection, _writes, run
from midyear.plans.single_page import single_pages
from midyear.plans.walk import fetch_level, first_level, next_frontier, visited_homepages
from midyear.schemas import ATTEMPTS, CAPTURES, RESPONSES
from midyear.session import Stored, checkpoint_path
from midyear.sources import lists as L
from midyear.sources.captures import Archive, capture_times, checked, extract, open_archive, write_archive
from midyear.sources.tables import empty_errors, empty_pages
from verification import views as V

HTML = "html"
SITE = ["website", "year_query"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _printable(rows: DataFrame) -> DataFrame:
    """Without the wall clock, and with times as text: years before 1677 do not fit every client."""
    for name, kind in rows.dtypes:
        if kind == "timestamp":
            rows = rows.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))
    return rows


def _no_clock(rows: DataFrame) -> DataFrame:
    return _printable(rows.drop("lastModified"))


# --- lists -----------------------------------------------------------------

@query
def seeds(spark, sf_dir):
    return L.parse_seeds(V.seed_lines(spark, sf_dir))


@query
def bad_seed_lines(spark, sf_dir):
    return L.bad_seed_lines(V.seed_lines(spark, sf_dir))


@query
def seeds_in_order(spark, sf_dir):
    """Seeds of a list of several files, each where it first stands."""
    path = checkpoint_path(spark, "list")
    V.listed_seeds(spark, sf_dir).write.text(path)
    return L.first_listed(L.read_numbered_lines(spark, path))


@query
def availability_urls(spark, sf_dir):
    return V.seeds(spark, sf_dir).select(
        *SITE, U.availability_url(F.col("website"), F.col("year_query")).alias("query_url")
    )


@query
def retry_page_rows(spark, sf_dir):
    """The list of pages to retry, written as lines and read back."""
    lines = L.retry_page_lines(E.pages_to_retry(V.errors(spark, sf_dir)))
    return L.parse_retry_pages(lines)


@query
def retry_rows_without_url(spark, sf_dir):
    """Pages to retry that lack their processed URL."""
    rows = E.pages_to_retry(V.errors_lacking_urls(spark, sf_dir))
    return L.rows_without_url(rows).select(*SITE, "original_url", "depth")


# --- URLs ------------------------------------------------------------------

@query
def hosts(spark, sf_dir):
    urls = V.captures(spark, sf_dir).select("page_id", F.col("final_url").alias("url")).unionByName(
        V.odd_links(spark, sf_dir).select("page_id", F.col("href").alias("url"))
    )
    return urls.select("page_id", "url", U.host_of_url(F.col("url")).alias("host"))


@query
def links_resolved(spark, sf_dir):
    return V.all_links(spark, sf_dir).select(
        "site", "page_id", "href", computed(U.resolve_href(F.col("href"), F.col("site"))).alias("link")
    )


def _links(spark, sf_dir):
    return links_resolved(spark, sf_dir).withColumn("year_query", (2014 + F.col("page_id") % 7).cast("int"))


@query
def url_keys(spark, sf_dir):
    urls = V.captures(spark, sf_dir).select("site", F.col("final_url").alias("url")).unionByName(
        links_resolved(spark, sf_dir).select("site", F.col("link").alias("url"))
    )
    return urls.select("site", "url", U.url_key(F.col("url"), F.col("site")).alias("url_key"))


@query
def snapshot_times(spark, sf_dir):
    url = F.col("final_url")
    return _printable(V.captures(spark, sf_dir).select(
        "page_id",
        U.capture_time_text(url).alias("snapshot_date_string"),
        U.snapshot_date(url).alias("snapshot_date"),
        F.year(U.snapshot_date(url)).alias("year_obtained"),
        U.year_of_query(F.concat(F.substring("ts14", 1, 4), F.lit("0701"))).alias("year_query"),
    ))


@query
def link_filters(spark, sf_dir):
    link = F.col("link")
    return links_resolved(spark, sf_dir).select(
        "site", "link",
        U.is_fetchable_file(link).alias("file_ok"),
        U.is_not_product(link).alias("path_ok"),
        U.is_on_site(link, F.col("site")).alias("on_site"),
    )


@query
def year_window(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "year_query", "link", U.in_year_window(F.col("link"), F.col("year_query"), 1).alias("in_window")
    )


# --- HTML ------------------------------------------------------------------

def _numbered(spark, sf_dir, parts, name) -> DataFrame:
    found = V.captures(spark, sf_dir).select("page_id", computed(parts).alias("parts"))
    return found.select("page_id", F.posexplode("parts").alias("pos", name))


@query
def hrefs_distinct(spark, sf_dir):
    return _numbered(spark, sf_dir, H.hrefs(F.col(HTML)), "href")


@query
def titles(spark, sf_dir):
    return V.captures(spark, sf_dir).select("page_id", H.title(F.col(HTML)).alias("title"))


@query
def title_fallback(spark, sf_dir):
    """Pages whose number is a multiple of five get an empty title first."""
    html = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("html", "(?s)<title>.*?</title>", "")).otherwise(F.col(HTML))
    return V.captures(spark, sf_dir).select("page_id", H.title_or_fallback(html).alias("title"))


@query
def text_blocks(spark, sf_dir):
    return _numbered(spark, sf_dir, H.text_blocks(F.col(HTML)), "block")


@query
def page_text(spark, sf_dir):
    return V.captures(spark, sf_dir).select("page_id", H.page_text(F.col(HTML)).alias("text"))


@query
def no_text_errors(spark, sf_dir):
    return V.captures(spark, sf_dir).where(H.page_text(F.col(HTML)) == "").select(
        "page_id", F.lit("No text found").alias("error_message")
    )


@query
def visible_text(spark, sf_dir):
    """Every third page has text directly in its head, and behind its last element."""
    loose = F.concat(F.replace(F.col(HTML), F.lit("<head>"), F.lit("<head>loose<meta name=a>more")), F.lit("after"))
    html = F.when(F.col("page_id") % 3 == 0, loose).otherwise(F.col(HTML))
    return _numbered(spark, sf_dir, H.visible_texts(html), "text")


@query
def content_gate(spark, sf_dir):
    return V.captures(spark, sf_dir).select("page_id", O.is_text(F.col("content_type")).alias("is_text"))


# --- answers and responses -------------------------------------------------

@query
def api_outcomes(spark, sf_dir):
    return locate_by_answers(V.api_responses(spark, sf_dir)).select(*SITE, "capture_url", "query_url", "answer_error")


@query
def attempts_resolved(spark, sf_dir):
    """Every round of the log by itself."""
    return resolve_attempts(V.attempts(spark, sf_dir), ["url", "round"], ["transport_error", "final_url"], attempts=3)


@query
def throttled_second_round(spark, sf_dir):
    return resolve_rounds(V.attempts(spark, sf_dir), "url", ["transport_error", "final_url"], attempts=3)


@query
def compacted_attempts(spark, sf_dir):
    """What of the log must be kept, when it comes in two parts."""
    log = checked(V.attempt_log(spark, sf_dir), ATTEMPTS)
    first = compacted(log.where("round = 1 or attempt = 1"), "url", 3)
    return compacted(first.unionByName(log.where("round = 2 and attempt > 1")), "url", 3).select("url", "round", "attempt", "status")


def _outcome(spark, sf_dir, rule, *more, **options) -> DataFrame:
    columns = map(F.col, (*RESPONSE, *more))
    return V.captures(spark, sf_dir).select("page_id", rule(*columns, **options).alias("error"))


RESPONSE = ("status", "final_url", "transport_error")


@query
def homepage_outcomes(spark, sf_dir):
    return _outcome(spark, sf_dir, O.homepage_error)


@query
def page_outcomes(spark, sf_dir):
    return _outcome(spark, sf_dir, O.page_error)


@query
def link_outcomes(spark, sf_dir):
    return _outcome(spark, sf_dir, O.link_error, "content_type")


@query
def link_outcomes_strict(spark, sf_dir):
    return _outcome(spark, sf_dir, O.link_error, "content_type", strict_status=True)


# --- nearest capture, frontier, fetch --------------------------------------

@query
def nearest_captures(spark, sf_dir):
    times = capture_times(V.captures(spark, sf_dir))
    return _printable(nearest_capture(V.seeds(spark, sf_dir), times))


@query
def nearest_from_index(spark, sf_dir):
    """From stored ends of captures that came in two parts."""
    captures = V.captures(spark, sf_dir)
    parts = [cut_lineage(capture_ends(capture_times(captures.where(some)))) for some in ("page_id % 3 = 0", "page_id % 3 <> 0")]
    return _printable(nearest_end(V.seeds(spark, sf_dir), merge_ends(*parts)))


def _candidates(spark, sf_dir) -> DataFrame:
    """The links of every capture, as candidates of its site and year."""
    link, site, year = F.col("link"), F.col("site"), F.col("year_query")
    return (
        _links(spark, sf_dir)
        .where(U.is_eligible(link, site, year, 1))
        .select(
            site.alias("website"),
            "year_query",
            F.col("page_id").alias("position"),
            F.lit(0).alias("taken"),
            F.lit(0).alias("n_retries_api"),
            "link",
            computed(U.url_key(link, site)).alias("url_key"),
        )
    )


@query
def first_per_key(spark, sf_dir):
    return R.first_per_key(_candidates(spark, sf_dir)).select(*SITE, "url_key", "position", "link")


def _visited(spark, sf_dir) -> DataFrame:
    return V.captures(spark, sf_dir).where("status = 200").select(
        F.col("site").alias("website"),
        (2014 + F.col("page_id") % 7).cast("int").alias("year_query"),
        U.url_key(F.col("final_url"), F.col("site")).alias("url_key"),
    ).distinct()


def _fresh(spark, sf_dir) -> DataFrame:
    return R.not_visited(R.first_per_key(_candidates(spark, sf_dir)), _visited(spark, sf_dir))


@query
def not_visited(spark, sf_dir):
    return _fresh(spark, sf_dir).select(*SITE, "url_key", "position", "link")


@query
def quota(spark, sf_dir):
    return R.within_quota(_fresh(spark, sf_dir), 5).select(*SITE, "link", "n_page")


def _homepages(spark, sf_dir) -> Stored:
    archive = V.archive(spark, sf_dir)
    return visit_homepages(locate(V.seeds(spark, sf_dir), archive), archive, CrawlConfig())


def _frontier(spark, sf_dir) -> Stored:
    homepages = _homepages(spark, sf_dir)
    level = first_level(opened_homepages(homepages.rows), homepages.keys)
    return next_frontier(level, visited_homepages(level.rows), V.archive(spark, sf_dir), CrawlConfig())


@query
def frontier_depth1(spark, sf_dir):
    """Links of the homepages of all seeds."""
    return _frontier(spark, sf_dir).rows.select(*SITE, "link", "n_page", "n_retries_api")


@query
def fetched_links(spark, sf_dir):
    visits = fetch_level(_frontier(spark, sf_dir), V.archive(spark, sf_dir), 1, CrawlConfig())
    return visits.rows.select(*SITE, "n_page", "url", "status", "final_url", "nretries_link", "error")


# --- whole plans -----------------------------------------------------------

@query
def homepage_pages(spark, sf_dir):
    """Nearest capture, response, text: the homepage of every seed."""
    return _no_clock(_crawl(spark, sf_dir, depth=0).pages)


@query
def homepage_failures(spark, sf_dir):
    return _no_clock(homepage_errors_of(_homepages(spark, sf_dir).rows))


def _merged_pages(spark, done) -> DataFrame:
    return _no_clock(M.merge_pages(empty_pages(spark), _writes(done.pages, "walk", 0)))


def _merged_errors(spark, done) -> DataFrame:
    errors = M.merge_homepage_errors(empty_errors(spark), _writes(done.homepage_errors, "homepage", 0))
    return _no_clock(M.merge_page_errors(errors, _writes(done.page_errors, "walk", 0)))


def _crawl(spark, sf_dir, depth=1):
    return crawl(V.seeds(spark, sf_dir), V.archive(spark, sf_dir), CrawlConfig(depth=depth))


@query
def crawl_pages(spark, sf_dir):
    return _merged_pages(spark, _crawl(spark, sf_dir))


@query
def crawl_errors(spark, sf_dir):
    return _merged_errors(spark, _crawl(spark, sf_dir))


@query
def crawl_depth2(spark, sf_dir):
    return _merged_pages(spark, _crawl(spark, sf_dir, depth=2))


@query
def crawl_from_attempts(spark, sf_dir):
    """A crawl whose responses come from a log of attempts in two rounds."""
    config = CrawlConfig()
    fetched = Archive.of_attempts(V.attempt_log(spark, sf_dir), config.attempts)
    archive = replace(fetched, more_links=V.archive(spark, sf_dir).more_links)
    return _merged_pages(spark, crawl(V.seeds(spark, sf_dir), archive, config))


@query
def crawl_stored_archive(spark, sf_dir):
    """A crawl of a written archive, with all its pages met in their buckets."""
    path = checkpoint_path(spark, "archive")
    write_archive(V.captures(spark, sf_dir).select(*CAPTURES.fieldNames()), path, buckets=8)
    archive = replace(open_archive(spark, path), more_links=V.archive(spark, sf_dir).more_links)
    return _merged_pages(spark, crawl(V.seeds(spark, sf_dir), archive, CrawlConfig(broadcast_bytes=0)))


@query
def crawl_from_answers(spark, sf_dir):
    """A crawl whose homepages are named by stored availability answers."""
    located = locate_by_answers(V.capture_answers(spark, sf_dir))
    done = crawl_located(located, V.archive(spark, sf_dir), CrawlConfig())
    return _merged_pages(spark, done)


@query
def single_page_pass(spark, sf_dir):
    done = single_pages(V.retry_rows(spark, sf_dir), V.archive(spark, sf_dir))
    return _no_clock(done.pages)


@query
def single_page_errors(spark, sf_dir):
    done = single_pages(V.retry_rows(spark, sf_dir), V.archive(spark, sf_dir))
    return _no_clock(done.errors)


def _run(spark, sf_dir) -> Collection:
    # Many passes read the archive, so its HTML is parsed once, ahead of them, and its responses are stored.
    pages = cut_lineage(extract(V.captures(spark, sf_dir)).select("url", "hrefs", "title", "text"))
    more = cut_lineage(V.archive(spark, sf_dir).more_links)
    narrow = [
        V.captures(spark, sf_dir, healed).select("site", "ts14", *RESPONSES.fieldNames(), F.lit(healed).alias("healed"))
        for healed in range(4)
    ]
    stored = cut_lineage(reduce(DataFrame.unionByName, narrow))
    archives = []
    for healed in range(4):
        captures = stored.where(F.col("healed") == healed)
        archives.append(Archive(capture_times(captures), captures.select(*RESPONSES.fieldNames()), pages, more))
    return run(V.seeds(spark, sf_dir), archives, empty_errors(spark))


@query
def rerun_to_fixpoint(spark, sf_dir):
    """Pages after a crawl and both re-run loops."""
    return _no_clock(_run(spark, sf_dir).pages(empty_pages(spark)))


@query
def rerun_errors(spark, sf_dir):
    return _no_clock(_run(spark, sf_dir).errors)


@query
def rerun_counts(spark, sf_dir):
    """How many homepages and pages had failed before each round."""
    done = _run(spark, sf_dir)
    counts = [("homepage", i, n) for i, n in enumerate(done.homepage_counts)]
    counts += [("page", i, n) for i, n in enumerate(done.page_counts)]
    return spark.createDataFrame(counts, "kind string, round int, n long")


# --- tables ----------------------------------------------------------------

@query
def latest_writes(spark, sf_dir):
    keys = ["website", "year_query", "original_query_URL_wayback_machine"]
    return _printable(M.last_writes(V.error_writes(spark, sf_dir), keys)).select(
        *keys, "batch_no", "seq", "write_shape", "error_message"
    )


@query
def merge_pages(spark, sf_dir):
    return _printable(M.merge_pages(V.stored_pages(spark, sf_dir), V.page_writes(spark, sf_dir)))


@query
def merge_page_errors(spark, sf_dir):
    writes = V.error_writes(spark, sf_dir).where("write_shape <> 'homepage'")
    return _printable(M.merge_page_errors(V.errors(spark, sf_dir), _later(writes)))


@query
def merge_homepage_errors(spark, sf_dir):
    writes = V.error_writes(spark, sf_dir).where("write_shape = 'homepage'")
    return _printable(M.merge_homepage_errors(V.errors(spark, sf_dir), _later(writes)))


def _later(writes: DataFrame) -> DataFrame:
    """The same log in the opposite order and one year on, so keys recur and keys are new."""
    shifted = writes.where("seq % 2 = 1").withColumn("year_query", F.col("year_query") + 1)
    return writes.unionByName(shifted).withColumn("seq", -F.col("seq"))


def _errors_and_successes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The error table with the failures of a pass, what a crawl scraped, and what a later pass opened."""
    rows = V.retry_rows(spark, sf_dir)
    errors = V.errors(spark, sf_dir).unionByName(single_pages(rows, V.archive(spark, sf_dir)).errors)
    return errors, _crawl(spark, sf_dir, depth=0).scraped, single_pages(rows, V.archive(spark, sf_dir, 1)).opened


@query
def clear_errors(spark, sf_dir):
    errors, scraped, opened = _errors_and_successes(spark, sf_dir)
    return _no_clock(M.clear_page_errors(M.clear_homepage_errors(errors, scraped), opened))


@query
def cleared_counts(spark, sf_dir):
    return M.cleared_counts(*_errors_and_successes(spark, sf_dir))


@query
def retry_homepages(spark, sf_dir):
    return L.seed_lines(E.homepages_to_retry(V.errors(spark, sf_dir)))


@query
def retry_pages(spark, sf_dir):
    return L.retry_page_lines(E.pages_to_retry(V.errors(spark, sf_dir)))


@query
def error_counts(spark, sf_dir):
    return E.error_counts(V.errors(spark, sf_dir))


@query
def not_downloaded(spark, sf_dir):
    pages = V.stored_pages(spark, sf_dir).withColumn(
        "URL_wayback_machine_processed",
        F.concat(
            F.lit("http://web.archive.org/web/2016/"), F.col("downloaded_link"), F.lit("/index")
        ),
    )
    return _printable(E.not_downloaded(V.errors(spark, sf_dir), pages))


@query
def coverage(spark, sf_dir):
    return E.coverage(V.seeds(spark, sf_dir), V.stored_pages(spark, sf_dir), V.errors(spark, sf_dir))


@query
def site_years(spark, sf_dir):
    return E.site_years(V.error_writes(spark, sf_dir))
