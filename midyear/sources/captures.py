"""Stored captures, and what is read out of their HTML.

``write_archive`` parses the HTML of all captures once and stores the narrow
response columns next to ``hrefs``, ``title`` and ``text``, bucketed and sorted by
URL. Later jobs read only the columns they need, meet the rows in their buckets and
never see the HTML. A certificate beside the files says how they are dealt out and
that no URL stands there twice. A single job may read captures directly: it parses
the pages it visits, or all of them once if it visits many.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from midyear.functions import html as H
from midyear.functions.binding import computed
from midyear.functions.urls import capture_time
from midyear.operators.attempts import compacted, resolve_rounds
from midyear.operators.joins import restrict
from midyear.operators.nearest import capture_ends, nearest_end
from midyear.schemas import ARCHIVE, ATTEMPTS, CAPTURES, CERTIFICATE, RESPONSES
from midyear.session import Keys, checkpoint_path, cut_lineage

RESPONSE_COLUMNS = RESPONSES.fieldNames()
# What a log of fetch attempts has beside the columns of captures, n_retries left out.
ATTEMPT_KEY = ["url", "round", "attempt"]
BUCKETS = 64
BESIDE = "_certificate"
ENDS = "_capture_ends"


def checked(table: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``; raises if one is missing or of another type."""
    found = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if found.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"captures lack {', '.join(wrong)}; found {found}")
    return table.select(*schema.fieldNames())


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per captured URL: site, ts14, the columns of RESPONSES, html. Or a log of attempts."""
    found = spark.read.parquet(path)
    return checked(found, ATTEMPTS if is_attempt_log(found) else CAPTURES)


def extract(captures: DataFrame) -> DataFrame:
    html = F.col("html")
    return captures.select(
        "site",
        "ts14",
        *RESPONSE_COLUMNS,
        H.hrefs(html).alias("hrefs"),
        H.title(html).alias("title"),
        H.page_text(html).alias("text"),
    )


def is_attempt_log(captures: DataFrame) -> bool:
    return set(ATTEMPT_KEY) <= set(captures.columns)


def reject_repeated_urls(captures: DataFrame) -> None:
    """Raise if ``captures`` have a URL twice, or a log of attempts has an attempt twice.

    Joins with them would multiply rows. Reads the key only.
    """
    key = ATTEMPT_KEY if is_attempt_log(captures) else ["url"]
    _refuse(captures.groupBy(*key).count().where("count > 1").select("url").first())


def _refuse(twice: T.Row | None) -> None:
    if twice:
        raise ValueError(f"more than one capture of {twice[0]}; number attempts by round and attempt (Archive.of_attempts)")


def _qualified(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString()


def _bucketed(spark: SparkSession, path: str, schema: T.StructType, buckets: int, digest: str) -> DataFrame:
    """The files at ``path`` as a table that knows its buckets."""
    name = f"midyear_{uuid.uuid5(uuid.NAMESPACE_URL, f'{path} {buckets} {digest}').hex}"
    quoted = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema.toDDL()}) USING parquet"
        f" CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{quoted}'"
    )
    spark.catalog.refreshTable(name)
    return spark.table(name)


def write_bucketed(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """Store ``rows`` at a new path in ``buckets`` files by URL, each sorted; one shuffle, after which their joins by URL need none."""
    spark, name = rows.sparkSession, f"midyear_writing_{uuid.uuid4().hex}"
    path = _qualified(spark, path)
    dealt = rows.repartition(buckets, "url")
    dealt.write.mode("errorifexists").bucketBy(buckets, "url").sortBy("url").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    return _bucketed(spark, path, rows.schema, buckets, "")


def _content(table: DataFrame) -> T.Row:
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64("url")), F.lit(0)).alias("url_digest")).first()


def write_archive(captures: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store what the jobs read of ``captures``, which must have one row per URL.

    HTML is parsed where it is read; what was found in it is shuffled once, to its
    bucket. Choose ``buckets`` so that one holds some hundred MB. The certificate comes
    last, so an unfinished archive has none.
    """
    spark = captures.sparkSession
    table = write_bucketed(extract(captures.where("url is not null")).select(*ARCHIVE.fieldNames()), path, buckets)
    _refuse(table.groupBy("url").count().where("count > 1").select("url").first())  # bucket by bucket, without a shuffle
    capture_ends(capture_times(table)).write.parquet(f"{path.rstrip('/')}/{ENDS}")
    certificate = [(buckets, *_content(table), ARCHIVE.toDDL())]
    spark.createDataFrame(certificate, CERTIFICATE).coalesce(1).write.parquet(f"{path.rstrip('/')}/{BESIDE}")


def read_certificate(spark: SparkSession, path: str) -> T.Row | None:
    try:
        return spark.read.schema(CERTIFICATE).parquet(f"{path.rstrip('/')}/{BESIDE}").first()
    except AnalysisException:
        return None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_archive`` stored, bucketed by URL.

    Raises if the certificate is missing, or does not fit the URLs that are there.
    """
    said = read_certificate(spark, path)
    if not said:
        raise ValueError(f"{path} has no certificate: not an archive, or one whose writing did not end")
    if said.columns_ddl != ARCHIVE.toDDL():
        raise ValueError(f"{path} was written with other columns: {said.columns_ddl}")
    table = _bucketed(spark, _qualified(spark, path), ARCHIVE, said.buckets, f"{said.n_rows} {said.url_digest}")
    found = _content(table)
    if (found.n_rows, found.url_digest) != (said.n_rows, said.url_digest):
        raise ValueError(f"{path} is broken: it holds {found.n_rows} captures, its certificate says {said.n_rows} of certain URLs")
    return table


def open_archive(spark: SparkSession, path: str, attempts: int = 3) -> Archive:
    """What is stored at ``path``: an archive, captures or a log of fetch attempts; refused if a URL stands there twice."""
    said = read_certificate(spark, path)
    if said:
        ends = spark.read.parquet(f"{path.rstrip('/')}/{ENDS}")
        return replace(Archive.of(read_archive(spark, path), unique=True, buckets=said.buckets), ends=ends)
    captures = read_captures(spark, path)
    reject_repeated_urls(captures)
    return Archive.of_attempts(captures, attempts) if is_attempt_log(captures) else Archive.of(captures, unique=True)


def merge_attempts(logs: Sequence[DataFrame], path: str, attempts: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """Store the attempts of ``logs`` that can still decide, bucketed by URL.

    The first of them may be such a store: its rows are met in their buckets, and only
    the newer logs are shuffled. Nothing depends on how often a log was compacted on the way.
    """
    spark = logs[0].sparkSession
    whole = [checked(log, ATTEMPTS).repartition(buckets, "url") if i else checked(log, ATTEMPTS) for i, log in enumerate(logs)]
    merged = whole[0]
    for log in whole[1:]:
        merged = merged.unionByName(log)
    return write_bucketed(compacted(merged, "url", attempts), path, buckets)


@dataclass(frozen=True)
class Archive:
    """What the jobs read; one row per URL in ``responses`` and in ``pages``.

    times: site, url, captured_at. responses: the columns of RESPONSES.
    pages: url with either html or hrefs, title and text. more_links: url, href
    beside those of the pages, if any. buckets: how many the pages are dealt to by
    URL, if they are. chosen: url, round and attempt of the pages that count, if they are
    those of a log. ends: ``capture_ends`` of the times, if they are stored.
    """

    times: DataFrame
    responses: DataFrame
    pages: DataFrame
    more_links: DataFrame | None = None
    buckets: int | None = None
    chosen: DataFrame | None = None
    ends: DataFrame | None = None
    _parsed: list[Archive] = field(default_factory=list, compare=False, repr=False)

    @classmethod
    def of(cls, captures: DataFrame, unique: bool = False, buckets: int | None = None) -> Archive:
        """From captures, or from what ``write_archive`` stored of them.

        Raises if a URL stands there twice; ``unique`` says that this is known already.
        """
        if not unique:
            reject_repeated_urls(captures)
        content = ["html"] if "html" in captures.columns else ["hrefs", "title", "text"]
        return cls(
            times=capture_times(captures),
            # A response that names no final URL was not redirected.
            responses=captures.withColumn("final_url", F.coalesce("final_url", "url")).select(*RESPONSE_COLUMNS),
            pages=captures.select("url", *content),
            buckets=buckets,
        )

    @classmethod
    def of_attempts(cls, log: DataFrame, attempts: int) -> Archive:
        """From a log of fetch attempts: per URL the response that ``resolve_rounds`` picks, and its HTML.

        log: site, ts14, url, round, attempt, the other columns of RESPONSES but
        n_retries, and html. The choice is made once, without HTML, and stored; later
        reads take the HTML of the attempts chosen among the wanted URLs.
        """
        payload = ["transport_error", "final_url", "content_type", "n_redirects"]
        chosen = cut_lineage(resolve_rounds(log, "url", [*payload, "site", "ts14", "attempt"], attempts))
        return cls(
            times=capture_times(chosen),
            responses=chosen.withColumn("final_url", F.coalesce("final_url", "url")).select(*RESPONSE_COLUMNS),
            pages=log.select(*ATTEMPT_KEY, "html"),
            chosen=chosen.select(*ATTEMPT_KEY),
        )

    def nearest(self, seeds: DataFrame) -> DataFrame:
        """The capture nearest to mid-year for each seed; from stored ends no row per capture is read."""
        return nearest_end(seeds, capture_ends(self.times) if self.ends is None else self.ends)

    def responses_of(self, wanted: Keys, max_bytes: int) -> DataFrame:
        """Responses of the URLs in ``wanted``."""
        return restrict(self.responses, wanted, max_bytes, self.buckets)

    def _pages_of(self, wanted: Keys, max_bytes: int) -> DataFrame:
        """Pages of the URLs in ``wanted``, with html, or with what was read out of it."""
        if "html" in self.pages.columns and wanted.bytes > max_bytes:
            # Pages of so many URLs are parsed once, all of them, and dealt to buckets without their HTML.
            parsed = self.parsed()
            return restrict(parsed.pages, wanted, max_bytes, parsed.buckets)
        if self.chosen is None:
            return restrict(self.pages, wanted, max_bytes, self.buckets)
        attempts = restrict(self.chosen, wanted, max_bytes)  # as many as there are URLs, and a few bytes longer
        return self.pages.join(F.broadcast(attempts), ATTEMPT_KEY, "left_semi").drop("round", "attempt")

    def parsed(self) -> Archive:
        """The same archive with its pages parsed and bucketed; worked out once."""
        if not self._parsed:
            chosen = self.pages if self.chosen is None else self.pages.join(self.chosen, ATTEMPT_KEY, "left_semi")
            html = F.col("html")
            found = chosen.select("url", H.hrefs(html).alias("hrefs"), H.title(html).alias("title"), H.page_text(html).alias("text"))
            pages = write_bucketed(found, checkpoint_path(self.pages.sparkSession, "pages"), BUCKETS)
            self._parsed.append(Archive(self.times, self.responses, pages, self.more_links, BUCKETS))
        return self._parsed[0]

    def links_of(self, wanted: Keys, max_bytes: int) -> DataFrame:
        """(url, href) of the pages in ``wanted``.

        Pages are picked before their HTML is parsed.
        """
        pages = self._pages_of(wanted, max_bytes)
        if "html" in pages.columns:
            pages = pages.select("url", computed(H.hrefs(F.col("html"))).alias("hrefs"))
        links = pages.select("url", F.explode("hrefs").alias("href"))
        if self.more_links is not None:
            links = links.unionByName(restrict(self.more_links, wanted, max_bytes))
        return links

    def texts_of(self, wanted: Keys, max_bytes: int) -> DataFrame:
        """(url, title, text) of the pages in ``wanted``."""
        pages = self._pages_of(wanted, max_bytes)
        if "html" not in pages.columns:
            return pages.select("url", "title", "text")
        html = F.col("html")
        return pages.select("url", H.title(html).alias("title"), H.page_text(html).alias("text"))

    def with_texts(self, rows: DataFrame, wanted: Keys, max_bytes: int) -> DataFrame:
        """``rows``, those that ``wanted`` was counted on, with title and text of their pages by url, or null.

        Texts are not shuffled: rows within the bound are broadcast to where the pages are
        read, and more of them are dealt to the buckets of the pages.
        """
        wanted = replace(wanted, bytes=max(wanted.bytes, wanted.row_bytes // 4))
        texts = self.texts_of(wanted, max_bytes)
        if wanted.bytes > max_bytes:
            buckets = self.buckets or (self.parsed().buckets if "html" in self.pages.columns else None)
            return rows.repartition(buckets, "url").join(texts.hint("merge"), "url", "left") if buckets else rows.join(texts, "url", "left")
        found = texts.join(F.broadcast(rows), "url").select(*rows.columns, "title", "text")
        without = rows.join(F.broadcast(texts.select("url")), "url", "left_anti")
        nothing = F.lit(None).cast("string")
        return found.unionByName(without.select("*", nothing.alias("title"), nothing.alias("text")))


def capture_times(extracted: DataFrame) -> DataFrame:
    """(site, url, captured_at) of captures with a possible time."""
    return extracted.select("site", "url", capture_time(F.col("ts14")).alias("captured_at")).where(
        "captured_at is not null"
    )
