"""Column expressions on URLs: keys, capture times, link resolution, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from midyear import constants as K
from midyear.functions.binding import let

SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
CAPTURE_YEAR = "/web/([0-9]{4})[0-9]{4}[0-9]+/http"
NO_CAPTURE_TIME = "0001-01-01 00:00:00"


def availability_url(website: Column, year: Column) -> Column:
    """Query URL that asks for the capture of a site nearest to mid-year."""
    return F.concat(
        F.lit(K.AVAILABILITY_QUERY), website, F.lit("&timestamp="), year.cast("string"), F.lit(K.MID_YEAR_SUFFIX)
    )


def host_of_url(url: Column) -> Column:
    """``scheme://authority``; without an authority, ``scheme://path``; scheme defaults to http."""
    scheme = F.lower(F.regexp_extract(url, SCHEME, 1))
    rest = F.substring(url, F.length(scheme) + F.when(scheme == "", 1).otherwise(2), F.length(url))
    authority = F.regexp_extract(rest, "^//([^/?#]*)", 1)
    path = F.regexp_extract(F.regexp_replace(rest, "^//[^/?#]*", ""), "^[^?#]*", 0)
    place = F.when(authority != "", authority).otherwise(path)
    return F.when(place == "", "").otherwise(
        F.concat(F.when(scheme == "", "http").otherwise(scheme), F.lit("://"), place)
    )


def url_key(url: Column, website: Column) -> Column:
    """From the site name to the last character that is neither ``/`` nor ``$``.

    A URL without the site, or with nothing after it, is its own key.
    """
    tail = F.rtrim(F.substring(url, F.instr(url, website), F.length(url)), F.lit("/$"))
    return let(
        tail,
        lambda found: F.when(
            F.contains(url, website) & (F.length(found) > F.length(website)), found
        ).otherwise(url),
    )


def capture_time_text(url: Column) -> Column:
    """The 14 digits of the capture time, or ``''`` if absent or impossible."""
    digits = F.regexp_extract(url, "[0-9]{14}", 0)
    return F.when(capture_time(digits).isNotNull(), digits).otherwise("")


def capture_time(digits: Column) -> Column:
    """14 digits as a UTC time, null if impossible."""
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))


def snapshot_date(url: Column) -> Column:
    return F.coalesce(capture_time(F.regexp_extract(url, "[0-9]{14}", 0)), F.lit(NO_CAPTURE_TIME).cast("timestamp"))


def year_of_query(query_time: Column) -> Column:
    """Year of a query time such as ``20160701``."""
    return F.substring(query_time, 1, 4).cast("int")


def without_blanks(url: Column) -> Column:
    return F.regexp_replace(url, " +|\n", "")


def resolve_href(href: Column, website: Column) -> Column:
    """Absolute URL of an ``href`` found on an archived page of ``website``.

    An href holding ``http`` is taken as it is; another one is put below the
    site unless the site is in it. What then lacks a scheme is put below the
    archive root, where empty, ``.`` and ``..`` segments are resolved.
    """
    placed = (
        F.when(href.contains("http"), F.when(href.rlike("^[?#]"), F.concat(website, href)).otherwise(href))
        .when(F.contains(href, website), href)
        .otherwise(F.concat(website, F.lit("/"), href))
    )

    def below_root(url: Column) -> Column:
        done = url.rlike("http://web.archive.org/") | (
            url.rlike(SCHEME) & ~url.rlike("(?i)^http:")
        )
        relative = F.translate(F.regexp_replace(url, "(?i)^http:", ""), "\t\r\n", "")
        return F.when(done, url).otherwise(let(relative, _joined))

    return F.when(_is_plain(href), F.concat(F.lit(K.ARCHIVE_ROOT), href)).otherwise(let(placed, below_root))


def _is_plain(href: Column) -> Column:
    """Root-relative links to captures, such as ``/web/2016.../http://ex.com/a``.

    Most links of archived pages look so. They only need the root in front:
    nothing in them is dropped, resolved or an archive URL of its own.
    """
    absent = ("/.", "?#", "http://web", "\t", "\r", "\n")
    plain = href.startswith("/") & href.contains("http") & ~href.startswith("//")
    for part in absent:
        plain &= ~href.contains(part)
    return plain & ~href.endswith("#") & ~href.endswith("?")


def _joined(url: Column) -> Column:
    """A URL without scheme, joined to the archive root."""

    def with_path(path: Column) -> Column:
        # An empty fragment and an empty query leave no trace.
        rest = F.substring(url, F.length(path) + 1, F.length(url))
        rest = F.regexp_replace(F.regexp_replace(rest, "^([^#]*)#$", "$1"), "^\\?(#.*)?$", "$1")
        start = F.when(path.startswith("//"), F.concat(F.lit("http:"), path)).otherwise(
            F.concat(F.lit(K.ARCHIVE_ROOT + "/"), let(_without_root(path), _without_dots))
        )
        return F.concat(start, rest)

    return let(F.regexp_extract(url, "^[^?#]*", 0), with_path)


def _without_root(path: Column) -> Column:
    """Path after its leading ``/``; runs of ``/`` go from relative paths only."""
    return F.when(path.startswith("/"), F.substring(path, 2, F.length(path))).otherwise(
        F.regexp_replace(path, "/{2,}", "/")
    )


def _without_dots(path: Column) -> Column:
    dotted = F.concat(F.lit("/"), path, F.lit("/")).rlike("/\\.\\.?/")

    def folded(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda done, part: F.when(
                part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
            ).when(part == ".", done).otherwise(F.concat(done, F.array(part))),
        )
        # A last segment of dots names a folder.
        slash = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
        return let(
            F.array_join(kept, "/"), lambda joined: F.when(joined == "", "").otherwise(F.concat(joined, slash))
        )

    return F.when(dotted, let(F.split(path, "/", -1), folded)).otherwise(path)


def is_fetchable_file(url: Column) -> Column:
    return ~url.rlike("(?i)\\.(" + "|".join(K.BLOCKED_EXTENSIONS) + ")$")


def is_not_product(url: Column) -> Column:
    return ~F.lower(url).contains(K.BLOCKED_PATH)


def is_on_site(url: Column, website: Column) -> Column:
    return F.contains(F.lower(url), F.lower(website))


def in_year_window(url: Column, year: Column, year_range: int) -> Column:
    """Capture year within the range; a URL without a capture time passes."""
    found = F.regexp_extract(url, CAPTURE_YEAR, 1)
    return F.when(found == "", True).otherwise(
        found.cast("int").between(year - year_range, year + year_range)
    )


def is_eligible(url: Column, website: Column, year: Column, year_range: int) -> Column:
    return (
        is_fetchable_file(url)
        & is_not_product(url)
        & is_on_site(url, website)
        & in_year_window(url, year, year_range)
    )
