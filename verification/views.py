"""Inputs of the registered queries, derived from the ``pages`` table.

FIXTURES.md describes them. Every view is as large as the table it comes from.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from midyear import constants as K
from midyear.functions import html as H
from midyear.functions.binding import computed
from midyear.operators.merge import last_writes
from midyear.schemas import ERRORS, PAGE_KEY, PAGES
from midyear.sources.captures import Archive

# Pages of one site are numbered chunk by chunk, so no task holds a whole site.
CHUNK = 1 << 16
LINKS_PER_PAGE = 25


def _div(size: int) -> Column:
    return F.expr(f"page_id div {size}")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def captures(spark: SparkSession, sf_dir: str, healed: int = 0) -> DataFrame:
    """Stored responses. ``healed`` rounds later, some failed fetches have answered."""
    n = F.col("page_id")

    def part(value, width):
        return F.lpad(value.cast("string"), width, "0")

    ts14 = F.when(n % 50 == 49, "20149931000000").otherwise(
        F.concat(
            (2014 + n % 7).cast("string"),
            part(1 + (n * 5) % 12, 2),
            part(1 + (n * 3) % 28, 2),
            part(n % 24, 2),
            part((n * 7) % 60, 2),
            part((n * 13) % 60, 2),
        )
    )
    failed = (n % 23 == 0) & (_div(23) % 3 >= healed)
    home = F.concat(F.lit(K.ARCHIVE_ROOT + "/web/"), F.col("ts14"), F.lit("/"), F.col("page_url"))
    return (
        pages(spark, sf_dir)
        .withColumnRenamed("url", "page_url")
        .withColumn("ts14", ts14)
        .select(
            "page_id",
            F.regexp_replace(F.regexp_extract("page_url", "^https?://([^/?#]+)", 1), "^www[.]", "").alias("site"),
            "ts14",
            "page_url",
            home.alias("url"),
            F.when(n % 37 == 0, K.THROTTLE_PAGE)
            .when(n % 11 == 0, F.concat(home, F.lit("/index")))
            .otherwise(home).alias("final_url"),
            F.when(failed, None).when(n % 13 == 0, 404).when(n % 29 == 0, 503).otherwise(200).alias("status"),
            F.when(failed, "Error_detected: timeout").alias("transport_error"),
            F.when(n % 17 == 0, "application/pdf").when(n % 19 == 0, None)
            .otherwise("text/html; charset=utf-8").alias("content_type"),
            F.when((n % 37 == 0) | (n % 11 == 0), 1).otherwise(0).alias("n_redirects"),
            F.when(failed | (n % 13 == 0) | (n % 29 == 0), 3).otherwise(n % 3).cast("int").alias("n_retries"),
            # Every 31st page has no heading and no paragraph.
            F.when(n % 31 == 0, F.replace(F.replace("html", F.lit("<p>"), F.lit("<i>")), F.lit("<h1>"), F.lit("<i>")))
            .otherwise(F.col("html")).alias("html"),
        )
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site and year with a capture, and sites the archive does not know."""
    found = captures(spark, sf_dir).select(
        "page_id", F.col("site").alias("website"), (2014 + F.col("page_id") % 7).cast("int").alias("year_query")
    )
    known = found.select("website", "year_query").distinct()
    gone = found.where("page_id % 9 = 0").select(
        F.concat(F.lit("gone-"), "website").alias("website"), "year_query"
    )
    return known.unionByName(gone.distinct())


def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per page; four in ten are malformed in one of four ways."""
    return _seed_lines(spark, sf_dir).select("value")


def listed_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines in the order of their pages, dealt to four files."""
    return _seed_lines(spark, sf_dir).repartitionByRange(4, "page_id").sortWithinPartitions("page_id").select("value")


def _seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 10
    year = (2014 + F.col("page_id") % 7).cast("string")
    site = F.col("site")
    return captures(spark, sf_dir).select(
        "page_id",
        F.when(n == 3, site)
        .when(n == 5, F.concat(site, F.lit(","), year))
        .when(n == 7, F.concat(site, F.lit(", x")))
        .when(n == 9, F.lit(""))
        .otherwise(F.concat(F.lit(" "), site, F.lit(", "), year, F.lit("\t"))).alias("value")
    )


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures numbered 1, 2, ... within their site by page_id.

    Rows are numbered within a chunk of ids, chunks are counted, and the counts
    of the chunks before are added: exact, and no site is sorted in one task.
    """
    rows = captures(spark, sf_dir).select(
        "site", "page_id", "ts14", "page_url", _div(CHUNK).alias("chunk")
    )
    before = Window.partitionBy("site").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("site", "chunk").agg(F.count("*").alias("n")).select(
        "site", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("site", "chunk").orderBy("page_id")
    return (
        rows.withColumn("rn", F.row_number().over(within))
        .join(offsets, ["site", "chunk"])
        .select("site", "page_id", "ts14", "page_url", (F.col("offset") + F.col("rn")).alias("rn"))
    )


def archived_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, page_id, href): links to the next pages of the site, one case per filter.

    An equi-join on the number within the site, not a comparison of its pages.
    """
    pages_of_site = ranked(spark, sf_dir)
    sources = pages_of_site.select(
        "site",
        F.col("page_id").alias("source_id"),
        F.col("rn").alias("source_rn"),
        F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + LINKS_PER_PAGE)).alias("rn"),
    )
    case = (F.col("source_rn") + F.col("rn")) % 7
    stamp = F.concat(F.lit("/web/"), F.col("ts14"))
    direct = F.concat(stamp, F.lit("/"), F.col("page_url"))
    href = (
        F.when(case == 0, F.concat(direct, F.lit(".PDF")))
        .when(case == 1, F.concat(stamp, F.lit("/http://"), "site", F.lit("/products/"), F.col("page_id").cast("string")))
        .when(case == 2, F.concat(direct, F.lit("/")))
        .when(case == 3, F.concat(stamp, F.lit("id_/"), "page_url"))
        .when(case == 4, F.concat(stamp, F.lit("/http://other.example/"), F.col("page_id").cast("string")))
        .otherwise(direct)
    )
    return sources.join(pages_of_site, ["site", "rn"]).select(
        "site", F.col("source_id").alias("page_id"), href.alias("href")
    )


def odd_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, page_id, href): unusual hrefs, the same shapes for every page."""
    number = F.col("page_id").cast("string")
    site = F.col("site")
    shapes = [
        F.lit("#"),
        F.concat(F.lit("#s"), number),
        F.concat(F.lit("../up/"), number),
        F.concat(F.lit("./here/"), number),
        F.concat(F.lit("a//b/../c"), number, F.lit("/.")),
        F.concat(F.lit("mailto:x@"), site),
        F.concat(F.lit("//"), site, F.lit("/c"), number),
        F.concat(F.lit("redirect?u=http://"), number),
        F.concat(F.lit("?q=http://"), number),
        F.concat(F.lit("HTTP://"), site, F.lit("/A"), number, F.lit("?#")),
        F.lit("javascript:void(0)"),
        F.concat(site, F.lit("/x"), number, F.lit("#")),
    ]
    return captures(spark, sf_dir).select("site", "page_id", F.explode(F.array(*shapes)).alias("href"))


def page_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, page_id, href): distinct hrefs in the HTML."""
    found = captures(spark, sf_dir).select("site", "page_id", computed(H.hrefs(F.col("html"))).alias("hrefs"))
    return found.select("site", "page_id", F.explode("hrefs").alias("href"))


def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        page_hrefs(spark, sf_dir)
        .unionByName(archived_links(spark, sf_dir))
        .unionByName(odd_links(spark, sf_dir))
    )


def archive(spark: SparkSession, sf_dir: str, healed: int = 0) -> Archive:
    """Captures as an archive, with the archived links beside those of the HTML."""
    stored = captures(spark, sf_dir, healed)
    more = archived_links(spark, sf_dir).join(stored.select("page_id", "url"), "page_id").select("url", "href")
    return replace(Archive.of(stored, unique=True), more_links=more)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of fetch attempts: two rounds of four attempts per URL."""
    n = F.col("page_id")
    return attempt_log(spark, sf_dir).select("url", "round", "attempt", "status", "transport_error", "final_url")


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with all columns of captures; an attempt that was turned away has another body."""
    n = F.col("page_id")
    rows = captures(spark, sf_dir).withColumnRenamed("final_url", "landed").drop("status", "transport_error")
    rows = rows.withColumn("round", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = rows.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(4))))
    status = (
        F.when(n % 23 == 0, None)
        .when(n % 13 == 0, 404)
        .when(F.col("attempt") <= (n + F.col("round")) % 4, 503)
        .otherwise(200)
    )
    body = F.when(status == 503, F.lit("<h1>Busy</h1>")).when(status.isNotNull(), F.col("html"))
    return rows.select(
        "site",
        "ts14",
        "url",
        "round",
        "attempt",
        status.alias("status"),
        F.when(n % 23 == 0, F.concat(F.lit("Error_detected: timeout "), F.col("attempt").cast("string"))).alias(
            "transport_error"
        ),
        F.when((n % 37 == 0) & (n % 74 == 0) & (F.col("round") == 2), F.col("url"))
        .otherwise(F.col("landed")).alias("final_url"),
        "content_type",
        "n_redirects",
        body.alias("html"),
    )


def api_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.col("year_query").cast("string")
    kind = F.length("website") % 5
    found = F.concat(
        F.lit('{"url": "'), "website",
        F.lit('", "archived_snapshots": {"closest": {"available": true, "status": "200", "timestamp": "'), year,
        F.lit('0630120000", "url": "http://web.archive.org/web/'), year, F.lit("0630120000/http://"), "website",
        F.lit('/"}}}'),
    )
    return seeds(spark, sf_dir).select(
        "website",
        "year_query",
        F.when(kind == 0, None)
        .when(kind == 1, '{"archived_snapshots": {}}')
        .when(kind == 2, "gateway {error")
        .otherwise(found).alias("body"),
    )


def capture_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability answers that name, for every site and year, its first capture of that year by URL."""
    n = F.col("page_id")
    named = captures(spark, sf_dir).groupBy(
        F.col("site").alias("website"), (2014 + n % 7).cast("int").alias("year_query")
    ).agg(F.min("url").alias("url"))
    return named.select(
        "website", "year_query",
        F.concat(
            F.lit('{"archived_snapshots": {"closest": {"available": true, "status": "200", "url": "'), "url", F.lit('"}}}')
        ).alias("body"),
    )


def error_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of error upserts of all shapes, several to a key."""
    n = F.col("page_id")
    kind = n % 6
    homepage = kind == 0
    slot = F.concat(F.lit(K.ARCHIVE_ROOT + "/web/2016/"), "site", F.lit("/"), (n % 4).cast("string"))
    message = (
        F.when(n % 60 == 9, None)
        .when(homepage, "Domain not scraped at all, status_code: 404")
        .when(kind.isin(1, 5), K.NO_TEXT_MESSAGE)
        .when(kind == 2, "Error_from_request : status_code : 404")
        .when(kind == 3, "Error_from_request : status_code : 503")
        .otherwise("Error_detected: timeout")
    )
    single = ~homepage & (_div(6) % 2 == 1)
    walk = ~homepage & ~single
    return captures(spark, sf_dir).select(
        (n % 3).cast("int").alias("batch_no"),
        n.alias("seq"),
        F.when(homepage, "homepage").when(single, "single").otherwise("walk").alias("write_shape"),
        F.col("site").alias("website"),
        (2014 + n % 7).cast("int").alias("year_query"),
        F.when(homepage, F.col("url")).otherwise(slot).alias("original_query_URL_wayback_machine"),
        F.when(~homepage, F.concat(slot, F.when(n % 8 > 3, "/index").otherwise(" \n"))).alias(
            "URL_wayback_machine_processed"
        ),
        F.when(kind.isin(0, 5), 0).otherwise(1).alias("Depth"),
        message.alias("error_message"),
        F.when(homepage, True).alias("website_not_scrapped"),
        F.when(walk, n % 2 == 1).alias("Redirected"),
        F.when(walk, n % 5).cast("int").alias("n_retries_api"),
        F.when(~homepage, n % 4).cast("int").alias("nretries_link"),
        F.timestamp_seconds(n).alias("lastModified"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error table: the last write of each key, taken whole."""
    writes = error_writes(spark, sf_dir)
    flagged = last_writes(writes.where("write_shape = 'homepage'"), ["website", "year_query"])
    pages_ = last_writes(
        writes.where("write_shape <> 'homepage'"),
        ["website", "year_query", "original_query_URL_wayback_machine", "URL_wayback_machine_processed"],
    )
    return flagged.unionByName(pages_).select(*ERRORS.fieldNames())


def errors_lacking_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error table as if every fourth number of retries had lost the processed URL."""
    processed = F.col("URL_wayback_machine_processed")
    return errors(spark, sf_dir).withColumn(
        "URL_wayback_machine_processed", F.when(~F.col("nretries_link").eqNullSafe(3), processed)
    )


def page_writes(spark: SparkSession, sf_dir: str, slots: int = 4) -> DataFrame:
    """Log of page upserts with whole texts; ``slots`` URLs per site and year share the rows."""
    n = F.col("page_id")
    single = n % 3 == 2
    link = F.concat("site", F.lit("/"), (n % slots).cast("string"))
    url = F.concat(F.lit(K.ARCHIVE_ROOT + "/web/20160701000000/http://"), link)
    html = F.col("html")
    return captures(spark, sf_dir).select(
        (_div(5) % 3).cast("int").alias("batch_no"),
        n.alias("seq"),
        F.when(single, "single").otherwise("walk").alias("write_shape"),
        F.col("site").alias("website"),
        link.alias("downloaded_link"),
        (2014 + n % 7).cast("int").alias("year_query"),
        url.alias("original_query_URL_wayback_machine"),
        url.alias("URL_wayback_machine_processed"),
        F.when(~single, n % 21).cast("int").alias("n_page_downloaded"),
        F.when(n % 4 != 0, H.title(html)).alias("Title_page"),
        H.page_text(html).alias("TextContent"),
        F.lit("20160701000000").alias("snapshot_date_string"),
        F.timestamp_seconds(n * 60).alias("snapshot_date"),
        F.lit(2016).alias("year_obtained"),
        (n % 2 == 0).alias("Redirected"),
        F.lit(1).alias("Depth"),
        F.when(~single & (n % 5 != 0), n % 3).cast("int").alias("n_retries_api"),
        (n % 4).cast("int").alias("nretries_link"),
        F.timestamp_seconds(n).alias("lastModified"),
    )


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page table written earlier; only some of its keys recur in ``page_writes``."""
    return last_writes(page_writes(spark, sf_dir, slots=6), PAGE_KEY).select(*PAGES.fieldNames())


def retry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of pages to fetch again: every capture, under two original URLs in turn."""
    n = F.col("page_id")
    return captures(spark, sf_dir).select(
        F.col("site").alias("website"),
        (2014 + n % 7).cast("int").alias("year_query"),
        F.when(n % 4 == 0, F.concat("url", F.lit("?from"))).otherwise(F.col("url")).alias("original_url"),
        F.when(n % 10 == 9, F.concat("url", F.lit("/gone"))).otherwise(F.col("url")).alias("processed_url"),
        F.lit(1).alias("depth"),
    )
