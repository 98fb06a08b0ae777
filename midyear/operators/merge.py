"""Keyed writes: merge, last write, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from midyear.config import CrawlConfig
from midyear.schemas import ERRORS, HOMEPAGE_ERROR_KEY, PAGE_ERROR_KEY, PAGE_KEY, PAGES
from midyear.session import store

ORDER = ["batch_no", "seq"]
TEXT = "TextContent"

# The fields each kind of write sets besides its key; others keep their value.
_SINGLE_PAGE = [
    "Title_page", "TextContent", "snapshot_date_string", "snapshot_date", "year_obtained",
    "Redirected", "Depth", "nretries_link", "lastModified",
]
PAGE_SHAPES = {
    "walk": [*_SINGLE_PAGE, "n_page_downloaded", "n_retries_api"],
    "single": _SINGLE_PAGE,
}
_SINGLE_ERROR = ["Depth", "nretries_link", "error_message", "lastModified"]
PAGE_ERROR_SHAPES = {
    "walk": [*_SINGLE_ERROR, "Redirected", "n_retries_api"],
    "single": _SINGLE_ERROR,
}
HOMEPAGE_ERROR_SHAPES = {
    "homepage": [
        "original_query_URL_wayback_machine", "Depth", "error_message", "website_not_scrapped", "lastModified",
    ],
}


def last_writes(writes: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """The latest write per key, whole; an aggregation, so rewrites collapse before the shuffle."""
    rest = [c for c in writes.columns if c not in keys]
    return (
        writes.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("w"))
        .select(*keys, "w.*")
    )


def merge_by_key(
    existing: DataFrame,
    writes: DataFrame,
    keys: list[str],
    shapes: dict[str, list[str]],
    order: list[str] = ORDER,
) -> DataFrame:
    """Upsert ``writes`` into ``existing``, field by field.

    A field takes its value from the last write of the key that sets it, also
    if that value is null; a field no write sets stays. ``write_shape`` of a
    write names its kind in ``shapes``. The result has the columns of
    ``existing``; keys are unique in ``existing`` and never null.

    The writes are brought to one row per key, which leaves them spread by key;
    one outer join with ``existing`` then updates and inserts at once.
    """
    latest = _latest(writes, keys, existing.columns, shapes, order=order)
    return _updated(existing, latest, keys, existing.columns, shapes, "full")


def _groups(columns: list[str], keys: list[str], shapes: dict[str, list[str]]) -> dict[tuple[str, ...], list[str]]:
    """Fields by the kinds of writes that set them."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for field in columns:
        kinds = tuple(kind for kind, sets in shapes.items() if field in sets)
        if kinds and field not in keys:
            groups.setdefault(kinds, []).append(field)
    return groups


def _latest(
    writes: DataFrame, keys: list[str], columns: list[str], shapes: dict[str, list[str]], *more: Column, order: list[str] = ORDER
) -> DataFrame:
    """One row per key: per group of fields the last values set (w0, w1, ...), and whether any were (set0, ...)."""
    aggregates = list(more)
    for number, (kinds, names) in enumerate(_groups(columns, keys, shapes).items()):
        sets = F.col("write_shape").isin(*kinds)
        aggregates += [
            F.max_by(F.when(sets, F.struct(*names)), F.when(sets, F.struct(*order))).alias(f"w{number}"),
            F.max(sets).alias(f"set{number}"),
        ]
    return writes.groupBy(*keys).agg(*aggregates)


def _updated(
    existing: DataFrame, latest: DataFrame, keys: list[str], columns: list[str], shapes: dict[str, list[str]], how: str, *more: Column
) -> DataFrame:
    merged = {}
    for number, names in enumerate(_groups(columns, keys, shapes).values()):
        for name in names:
            merged[name] = F.when(F.col(f"set{number}"), F.col(f"w{number}.{name}")).otherwise(F.col(name)).alias(name)
    return existing.join(latest, keys, how).select(*(merged.get(c, F.col(c)) for c in columns), *more)


def merge_pages(existing: DataFrame, writes: DataFrame, max_bytes: int = CrawlConfig.broadcast_bytes) -> DataFrame:
    """Upsert page ``writes`` into ``existing``, as ``merge_by_key`` does, without moving texts to decide.

    First the narrow columns are merged per written key, which also names the write that
    the text comes from; they are stored. Then these rows meet the texts of the writes
    where those are read, and the other rows of ``existing`` pass through: what was
    decided is broadcast within ``max_bytes``. Beyond that the texts that stay are
    shuffled once, unsorted. Every write of a page sets its text, and no write stands in the log twice.
    """
    # The clock may read otherwise when the writes are read again.
    lasting = sorted(set(writes.columns) - {*ORDER, "lastModified"})
    order = F.struct(*ORDER, F.xxhash64(*lasting).alias("content"))
    narrow = [c for c in existing.columns if c != TEXT]
    marked = writes.select("*", order.alias("at"))
    latest = _latest(marked.drop(TEXT), PAGE_KEY, narrow, PAGE_SHAPES, F.max("at").alias("text_at"))
    merged = _updated(existing.select(*narrow), latest, PAGE_KEY, narrow, PAGE_SHAPES, "right", F.col("text_at"))
    decided = store(merged, PAGE_KEY[-1])
    texts = marked.select(*PAGE_KEY, F.col("at").alias("text_at"), TEXT)
    keys = decided.rows.select(*PAGE_KEY)
    if decided.keys.row_bytes <= max_bytes:
        written = texts.join(F.broadcast(decided.rows), [*PAGE_KEY, "text_at"])
        untouched = existing.join(F.broadcast(keys), PAGE_KEY, "left_anti")
    else:
        written = texts.join(decided.rows.hint("shuffle_hash"), [*PAGE_KEY, "text_at"])
        untouched = existing.join(keys.hint("shuffle_hash"), PAGE_KEY, "left_anti")
    fields = PAGES.fieldNames()
    return written.select(*fields).unionByName(untouched.select(*fields))


def is_homepage_error() -> Column:
    return F.coalesce("website_not_scrapped", F.lit(False))


def merge_page_errors(existing: DataFrame, writes: DataFrame) -> DataFrame:
    """Upsert among the page errors; homepage errors pass through."""
    merged = merge_by_key(existing.where(~is_homepage_error()), writes, PAGE_ERROR_KEY, PAGE_ERROR_SHAPES)
    return merged.unionByName(existing.where(is_homepage_error())).select(*ERRORS.fieldNames())


def merge_homepage_errors(existing: DataFrame, writes: DataFrame) -> DataFrame:
    """Upsert among the homepage errors; page errors pass through."""
    merged = merge_by_key(existing.where(is_homepage_error()), writes, HOMEPAGE_ERROR_KEY, HOMEPAGE_ERROR_SHAPES)
    return merged.unionByName(existing.where(~is_homepage_error())).select(*ERRORS.fieldNames())


def clear_homepage_errors(errors: DataFrame, scraped: DataFrame) -> DataFrame:
    """Without the homepage errors of sites and years in ``scraped``.

    Only homepage errors, one per site and year, take part in the join.
    """
    return _cleared(errors, is_homepage_error(), scraped, HOMEPAGE_ERROR_KEY)


def clear_page_errors(errors: DataFrame, opened: DataFrame) -> DataFrame:
    """Without the page errors whose key is in ``opened``."""
    return _cleared(errors, ~is_homepage_error(), opened, PAGE_ERROR_KEY)


def _cleared(errors: DataFrame, concerned: Column, done: DataFrame, keys: list[str]) -> DataFrame:
    kept = errors.where(concerned).join(done.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*errors.columns).unionByName(errors.where(~concerned))


def cleared_counts(errors: DataFrame, scraped: DataFrame, opened: DataFrame) -> DataFrame:
    """How many rows the two deletes remove."""
    sites = scraped.select(*HOMEPAGE_ERROR_KEY).distinct()
    pages = opened.select(*PAGE_ERROR_KEY).distinct()
    homepage = (
        errors.where(is_homepage_error()).join(sites, HOMEPAGE_ERROR_KEY, "left_semi")
        .agg(F.count("*").alias("n")).select(F.lit("homepage").alias("kind"), "n")
    )
    page = (
        errors.where(~is_homepage_error()).join(pages, PAGE_ERROR_KEY, "left_semi")
        .agg(F.count("*").alias("n")).select(F.lit("page").alias("kind"), "n")
    )
    return homepage.unionByName(page)
