"""Table schemas. NULL stands for an absent field."""

from __future__ import annotations

from pyspark.sql import types as T

SEEDS = T.StructType([
    T.StructField("website", T.StringType()),
    T.StructField("year_query", T.IntegerType()),
])

ANSWERS = T.StructType([
    *SEEDS.fields,
    T.StructField("body", T.StringType()),
])

RETRY_PAGES = T.StructType([
    T.StructField("website", T.StringType()),
    T.StructField("year_query", T.IntegerType()),
    T.StructField("original_url", T.StringType()),
    T.StructField("processed_url", T.StringType()),
    T.StructField("depth", T.IntegerType()),
])

# One stored response per requested URL. A null status goes with an error text.
RESPONSES = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("transport_error", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("n_redirects", T.IntegerType()),
    T.StructField("n_retries", T.IntegerType()),
])

_CAPTURE = [T.StructField("site", T.StringType()), T.StructField("ts14", T.StringType())]
_HTML = T.StructField("html", T.StringType())
CAPTURES = T.StructType([*_CAPTURE, *RESPONSES.fields, _HTML])

# A log of fetch attempts: numbered, with the outcome of each.
ATTEMPTS = T.StructType([
    *_CAPTURE,
    T.StructField("url", T.StringType()),
    T.StructField("round", T.IntegerType()),
    T.StructField("attempt", T.IntegerType()),
    *(f for f in RESPONSES.fields if f.name not in ("url", "n_retries")),
    _HTML,
])

# What is stored of captures whose HTML has been read.
ARCHIVE = T.StructType([
    *_CAPTURE,
    *RESPONSES.fields,
    T.StructField("hrefs", T.ArrayType(T.StringType())),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
])

# Kept beside an archive; url_digest is the exclusive or of the hashes of its URLs.
CERTIFICATE = T.StructType([
    T.StructField("buckets", T.IntegerType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("url_digest", T.LongType()),
    T.StructField("columns_ddl", T.StringType()),
])

PAGE_KEY = [
    "website",
    "downloaded_link",
    "year_query",
    "original_query_URL_wayback_machine",
    "URL_wayback_machine_processed",
]

PAGES = T.StructType([
    T.StructField("website", T.StringType()),
    T.StructField("downloaded_link", T.StringType()),
    T.StructField("year_query", T.IntegerType()),
    T.StructField("original_query_URL_wayback_machine", T.StringType()),
    T.StructField("URL_wayback_machine_processed", T.StringType()),
    T.StructField("n_page_downloaded", T.IntegerType()),
    T.StructField("Title_page", T.StringType()),
    T.StructField("TextContent", T.StringType()),
    T.StructField("snapshot_date_string", T.StringType()),
    T.StructField("snapshot_date", T.TimestampType()),
    T.StructField("year_obtained", T.IntegerType()),
    T.StructField("Redirected", T.BooleanType()),
    T.StructField("Depth", T.IntegerType()),
    T.StructField("n_retries_api", T.IntegerType()),
    T.StructField("nretries_link", T.IntegerType()),
    T.StructField("lastModified", T.TimestampType()),
])

PAGE_ERROR_KEY = [
    "website",
    "year_query",
    "original_query_URL_wayback_machine",
    "URL_wayback_machine_processed",
]
HOMEPAGE_ERROR_KEY = ["website", "year_query"]

ERRORS = T.StructType([
    T.StructField("website", T.StringType()),
    T.StructField("year_query", T.IntegerType()),
    T.StructField("original_query_URL_wayback_machine", T.StringType()),
    T.StructField("URL_wayback_machine_processed", T.StringType()),
    T.StructField("Depth", T.IntegerType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("website_not_scrapped", T.BooleanType()),
    T.StructField("Redirected", T.BooleanType()),
    T.StructField("n_retries_api", T.IntegerType()),
    T.StructField("nretries_link", T.IntegerType()),
    T.StructField("lastModified", T.TimestampType()),
])
