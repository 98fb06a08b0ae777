import datetime
import random

from pyspark.sql import functions as F

from midyear.functions import outcomes as O
from midyear.operators.attempts import resolve_attempts, resolve_rounds
from midyear.operators.nearest import nearest_capture
from midyear.plans.crawl import locate_by_answers


def test_nearest_capture(spark):
    """A third of all captures belong to one site."""
    rng = random.Random(3)
    start = datetime.datetime(2010, 1, 1, tzinfo=datetime.timezone.utc)
    captures = [
        (rng.choice(["hot", "hot", "a", "b", "c"]), f"u{i}", start + datetime.timedelta(hours=rng.randint(0, 24 * 3000)))
        for i in range(600)
    ]
    middle = datetime.datetime(2012, 7, 1, tzinfo=datetime.timezone.utc)
    captures += [
        ("tie", "late", middle + datetime.timedelta(days=1)), ("tie", "zz", middle - datetime.timedelta(days=1)),
        ("tie", "early", middle - datetime.timedelta(days=1)), ("exact", "x", middle),
    ]
    seeds = [(s, y) for s in ("hot", "a", "b", "c", "tie", "exact", "none") for y in range(2009, 2021)]
    expected = {}
    for site, year in seeds:
        target = datetime.datetime(year, 7, 1, tzinfo=datetime.timezone.utc)
        near = [(abs(at - target), at, url) for s, url, at in captures if s == site]
        if near:
            expected[site, year] = min(near)[2]
    got = nearest_capture(
        spark.createDataFrame(seeds + seeds[:5], "website string, year_query int"),
        spark.createDataFrame(captures, "site string, url string, captured_at timestamp"),
    )
    rows = got.collect()
    assert {(r.website, r.year_query): r.capture_url for r in rows} == expected
    assert len(rows) == len(expected)
    # Captures are reduced before they move, and no sites are paired with each other.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    below_join = plan.split("Join", 1)[1]
    assert "partial_min" in below_join


def test_attempts(spark):
    log = spark.createDataFrame(
        [("a", 1, 503, "x"), ("a", 2, 200, "y"), ("a", 3, 200, "z"), ("b", 1, None, "x"), ("b", 2, 404, "y"),
         ("b", 3, 503, "z"), ("b", 4, 200, "late"), ("c", 1, 200, "x")],
        "url string, attempt int, status int, final_url string",
    )
    got = {r.url: (r.status, r.final_url, r.n_retries) for r in resolve_attempts(log, "url", ["final_url"], 3).collect()}
    assert got == {"a": (200, "y", 1), "b": (503, "z", 3), "c": (200, "x", 0)}


def test_second_round_replaces_a_throttled_first(spark):
    throttled = "https://web.archive.org/429.html"
    log = spark.createDataFrame(
        [("a", 1, 1, 200, throttled), ("a", 2, 1, 503, "p"), ("a", 2, 2, 200, "q"),
         ("b", 1, 1, 200, "p"), ("b", 2, 1, 404, "q"), ("c", 1, 1, 200, throttled), ("d", 1, 1, 503, throttled),
         ("d", 2, 1, 200, "q")],
        "url string, round int, attempt int, status int, final_url string",
    )
    got = {r.url: tuple(r)[1:] for r in resolve_rounds(log, "url", ["final_url"], 3).collect()}
    assert got == {"a": (200, "q", 1, 2), "b": (200, "p", 0, 1), "c": (200, throttled, 0, 1), "d": (503, throttled, 3, 1)}


def test_answers(spark):
    bodies = ['{"archived_snapshots": {"closest": {"url": "http://w/1"}}}', '{"archived_snapshots": {}}',
              '{"archived_snapshots": {"closest": {}}}', "oops {", "oops", None]
    rows = spark.createDataFrame([(f"s{i}", 2016, b) for i, b in enumerate(bodies)],
                                 "website string, year_query int, body string")
    got = {r.website: (r.capture_url, (r.answer_error or "")[:10]) for r in locate_by_answers(rows).collect()}
    assert got == {"s0": ("http://w/1", ""), "s1": (None, "ID company"), "s2": (None, "ID company"),
                   "s3": (None, "ID company"), "s4": (None, "ID company"), "s5": (None, "Url not fo")}


def test_content_types(spark):
    kinds = ["text/html", "application/xhtml+xml", "x/hmtl", "application/pdf", None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i int, k string")
    assert [r[0] for r in rows.orderBy("i").select(O.is_text(F.col("k"))).collect()] == [True, True, True, False, True]


def test_messages(spark):
    throttled = "https://web.archive.org/429.html"
    rows = spark.createDataFrame(
        [(0, 200, "u", None), (1, 200, throttled, None), (2, 404, "u", None), (3, None, None, "Error_detected: t"),
         (4, None, None, None)],
        "i int, status int, final_url string, transport_error string",
    )
    columns = [F.col(c) for c in ("status", "final_url", "transport_error")]
    got = rows.orderBy("i").select(O.homepage_error(*columns), O.page_error(*columns)).collect()
    failed = "Domain not scraped at all because we do not access to the closest url returned by WaybackMachine API, "
    assert [tuple(r) for r in got] == [
        (None, None),
        (failed + "Error 429 : " + throttled, failed + "Error 429 : " + throttled),
        (failed + "status_code: 404", "Error_from_request : status_code : 404"),
        ("Error_detected: t", "Error_retry_acces : message : Error_detected: t"),
        ("Error_detected: no stored response", "Error_retry_acces : message : Error_detected: no stored response"),
    ]
