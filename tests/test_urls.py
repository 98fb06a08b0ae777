import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from midyear.functions import urls as U

ROOT = "http://web.archive.org/"


def values(spark, rows, schema, column):
    numbered = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in numbered.orderBy("i").select(column).collect()]


def joined(href, site):
    """The rule in the standard library's terms."""
    if "http" in href:
        found = urljoin(site, href)
    else:
        found = href if site in href else site + "/" + href
    return found if re.search(ROOT, found) else urljoin(ROOT, found)


LINKS = [
    ("/web/20120711125714/http://ex.com/a", "http://web.archive.org/web/20120711125714/http://ex.com/a"),
    ("https://web.archive.org/web/2012/http://ex.com", "https://web.archive.org/web/2012/http://ex.com"),
    ("http://ex.com/q", "http://ex.com/q"),
    ("/about", "http://web.archive.org/ex.com/about"),
    ("about", "http://web.archive.org/ex.com/about"),
    ("#top", "http://web.archive.org/ex.com/#top"),
    ("#", "http://web.archive.org/ex.com/"),
    ("ex.com/x", "http://web.archive.org/ex.com/x"),
    ("redirect?u=http://z", "http://web.archive.org/redirect?u=http://z"),
    ("mailto:a@ex.com", "mailto:a@ex.com"),
    ("//cdn.ex.com/p", "http://cdn.ex.com/p"),
    ("../up", "http://web.archive.org/up"),
    ("a/b/..", "http://web.archive.org/ex.com/a/"),
]


def test_links_resolve(spark):
    got = values(spark, [(h, "ex.com") for h, _ in LINKS], "h string, s string", U.resolve_href(F.col("h"), F.col("s")))
    assert got == [expected for _, expected in LINKS]


def test_links_resolve_like_urljoin(spark):
    parts = ["a", "b", "..", ".", "/", "//", "?", "#", "q=1", "http", "http://", "ex.com", ":", "&", "x.html", "%20"]
    rng = random.Random(5)
    hrefs = sorted({"".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(3000)})
    got = values(spark, [(h, "ex.com") for h in hrefs], "h string, s string", U.resolve_href(F.col("h"), F.col("s")))
    wrong = [(h, g, joined(h, "ex.com")) for h, g in zip(hrefs, got) if g != joined(h, "ex.com")]
    # Not followed: an empty authority or path after a scheme, and a scheme that
    # only appears once leading dots are resolved.
    odd = re.compile("^(http:)?//+([?#/]|$)|^http:([?#]|$)|^[.]{1,2}/+[^/?#]*:")
    wrong = [w for w in wrong if not odd.search(w[0])]
    assert not wrong, "\n".join(map(str, wrong))


KEYS = [
    ("http://web.archive.org/web/2014/http://www.ex.com/about/", "ex.com/about"),
    ("http://ex.com/", "http://ex.com/"),
    ("http://ex.com//a/b$", "ex.com//a/b"),
    ("http://ex.com/a?x=1/", "ex.com/a?x=1"),
    ("http://other.org/a", "http://other.org/a"),
    ("http://web.archive.org/web/20180706120726/http://ex.com:80/", "ex.com:80"),
]


def test_url_keys(spark):
    got = values(spark, [(u, "ex.com") for u, _ in KEYS], "u string, s string", U.url_key(F.col("u"), F.col("s")))
    assert got == [k for _, k in KEYS]


def test_site_is_literal(spark):
    rows = [("http://exxcom/a", "ex.com")]
    assert values(spark, rows, "u string, s string", U.url_key(F.col("u"), F.col("s"))) == ["http://exxcom/a"]
    assert values(spark, rows, "u string, s string", U.is_on_site(F.col("u"), F.col("s"))) == [False]


def test_capture_times(spark):
    urls = [
        ("http://web.archive.org/web/20120711125714/http://ex.com",),
        ("http://web.archive.org/web/20149931000000/http://ex.com",),
        ("http://ex.com",),
    ]
    assert values(spark, urls, "u string", U.capture_time_text(F.col("u"))) == ["20120711125714", "", ""]
    times = values(spark, urls, "u string", U.snapshot_date(F.col("u")).cast("string"))
    assert times == ["2012-07-11 12:57:14", "0001-01-01 00:00:00", "0001-01-01 00:00:00"]
    assert values(spark, urls, "u string", F.year(U.snapshot_date(F.col("u")))) == [2012, 1, 1]


@pytest.mark.parametrize("url, passes", [
    ("a.pdf", False), ("a.PDF", False), ("a.docx", False), ("a.mp4", False),
    ("a.jpeg", True), ("a.pdf?y", True), ("apdf", True), ("a.xlsx/", True),
])
def test_files(spark, url, passes):
    assert values(spark, [(url,)], "u string", U.is_fetchable_file(F.col("u"))) == [passes]


def test_products(spark):
    urls = [("http://ex.com/Products/1",), ("http://ex.com/products",)]
    assert values(spark, urls, "u string", U.is_not_product(F.col("u"))) == [False, True]


def test_year_window(spark):
    urls = [(f"http://web.archive.org/web/{2016 + d}0101000000/http://ex.com",) for d in (-2, -1, 0, 1, 2)]
    urls += [("http://web.archive.org/web/20100101000000id_/http://ex.com",), ("http://ex.com",)]
    got = values(spark, urls, "u string", U.in_year_window(F.col("u"), F.lit(2016), 1))
    assert got == [False, True, True, True, False, True, True]


def test_hosts(spark):
    urls = [("https://u@ex.com:80/a?b",), ("ex.com/a?b",), ("//ex.com/a",), ("mailto:x@y",), ("",)]
    got = values(spark, urls, "u string", U.host_of_url(F.col("u")))
    assert got == ["https://u@ex.com:80", "http://ex.com/a", "http://ex.com", "mailto://x@y", ""]


def test_availability_url(spark):
    got = values(spark, [("ex.com", 2015)], "s string, y int", U.availability_url(F.col("s"), F.col("y")))
    assert got == ["http://archive.org/wayback/available?url=ex.com&timestamp=20150701"]
