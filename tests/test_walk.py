"""The walk against a queue, one URL at a time."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from midyear import CrawlConfig
from midyear.operators.frontier import first_per_key, next_links, not_visited, within_quota
from midyear.plans import walk as W
from midyear.schemas import RESPONSES
from midyear.session import store
from midyear.sources.captures import Archive

ROOT = "http://web.archive.org"
SITES = ["ex.com", "b.org"]


def key_of(url, site):
    start = url.find(site)
    tail = url[start:].rstrip("/$") if start >= 0 else ""
    return tail if len(tail) > len(site) else url


def eligible(url, site, year, span):
    low = url.lower()
    if low.endswith((".pdf", ".jpg")) or "/products/" in low or site not in low:
        return False
    if "/web/" in url and "/http" in url[5:]:
        return abs(int(url.split("/web/")[1][:4]) - year) <= span
    return True


def make_world(seed):
    """Pages of two sites over three years, linking at random."""
    rng = random.Random(seed)
    responses, links, texts = [], [], []
    names = [f"p{i}" for i in range(14)]
    urls = {}
    for site in SITES:
        for year in (2014, 2015, 2016):
            for name in names:
                urls[site, year, name] = f"{ROOT}/web/{year}0701000000/http://{site}/{name}"
    for (site, year, name), url in urls.items():
        fate = rng.random()
        status = None if fate < 0.1 else 404 if fate < 0.2 else 200
        kind = "application/pdf" if rng.random() < 0.1 else "text/html"
        moved = rng.random() < 0.2
        if fate > 0.05:  # a few URLs have no response at all
            responses.append((
                url, status, "Error_detected: x" if status is None else None,
                url + "/moved" if moved else url, kind, int(moved), rng.randint(0, 2),
            ))
        texts.append((url, f"title {name}", "" if rng.random() < 0.1 else f"\n\n\n {site} {name} {year}"))
        for _ in range(rng.randint(2, 14)):
            other = urls[rng.choice([site, site, site, *SITES]), rng.choice([year, 2014, 2015, 2016]), rng.choice(names)]
            end = rng.choice(["", "", "", "/", ".PDF", "/products/1", "$"])
            links.append((url, (other + end).removeprefix(ROOT) if rng.random() < 0.5 else other + end))
    homes = [(site, year, urls[site, year, "p0"]) for site in SITES for year in (2014, 2015, 2016)]
    return responses, links, texts, homes


def queue_walk(world, config):
    """(site, year, depth, number, requested, error, processed) of every visit."""
    responses, links, texts, homes = world
    answer = {r[0]: r for r in responses}
    text_of = {t[0]: t[2] for t in texts}
    out_of = defaultdict(set)
    for url, href in links:
        out_of[url].add(href if href.startswith("http") else ROOT + href)
    rows = []

    def outcome(url, depth):
        got = answer.get(url)
        if got is None or got[1] is None:
            return (got[2] if got else "Error_detected: no stored response"), False
        if config.strict_status and got[1] != 200:
            return f"Link left out, answered with status {got[1]}", False
        if "text" not in got[4]:
            return f"Error_detected during self.download_page():{got[1]}", False
        return (None if text_of[url] else "No text found"), True

    for site, year, home in homes:
        got = answer[home]
        if "text" in got[4]:
            rows.append((site, year, 0, 0, got[3], None if text_of[home] else "No text found", got[3]))
            queue = deque((link, 1) for link in sorted(out_of[home]))
        else:
            error = f"Error_detected: in access url : {got[3]} \t status code: {got[1]}"
            rows.append((site, year, 0, 0, got[3], error, got[3]))
            queue = deque()
        seen, count = {got[3]}, 0
        while queue and count <= config.page_limit:
            url, depth = queue.popleft()
            if depth > config.depth:
                break
            key = key_of(url, site)
            if key in seen or not eligible(url, site, year, config.year_range):
                continue
            count += 1
            seen.add(key)
            error, opened = outcome(url, depth)
            landed = answer[url][3] if url in answer and answer[url][1] else url
            rows.append((site, year, depth, count, url, error, landed))
            if opened:
                queue.extend((link, depth + 1) for link in sorted(out_of[url]))
    return sorted(rows, key=str)


def page_table(spark, links, texts):
    hrefs = defaultdict(set)
    for url, href in links:
        hrefs[url].add(href)
    rows = [(url, sorted(hrefs[url]), title, text) for url, title, text in texts]
    return spark.createDataFrame(rows, "url string, hrefs array<string>, title string, text string")


def spark_walk(spark, world, config):
    responses, links, texts, homes = world
    archive = Archive(
        times=None,
        responses=spark.createDataFrame(responses, RESPONSES),
        pages=page_table(spark, links, texts),
    )
    seeds = spark.createDataFrame(homes, "website string, year_query int, url string")
    homepages = store(seeds.join(archive.responses, "url"), "url", W.readable_homepage())
    visits = W.walk(W.first_level(homepages.rows, homepages.keys), archive, config)
    outcomes = W.with_text(visits, archive, config)
    landed = W.processed_url(F.col("final_url"), F.col("status"), F.col("original_url"))
    rows = outcomes.select("website", "year_query", "depth", "n_page", "original_url", "error", landed).collect()
    return sorted((tuple(r) for r in rows), key=str), outcomes


def world_with_homes(seed):
    """A world whose homepages all answered."""
    responses, links, texts, homes = make_world(seed)
    home_urls = {h[2] for h in homes}
    responses = [r for r in responses if r[0] not in home_urls]
    responses += [(u, 200, None, u, "text/html", 0, 1) for u in sorted(home_urls)[1:]]
    # One of them is no text, and lands on another address.
    first = sorted(home_urls)[0]
    responses.append((first, 200, None, first + "/moved", "application/pdf", 1, 0))
    return responses, links, texts, homes


@pytest.mark.parametrize("seed, depth, limit, strict, broadcast", [
    (1, 1, 20, False, 1 << 20),
    (2, 1, 3, False, 0),
    (3, 2, 6, False, 1 << 20),
    (4, 3, 30, True, 1 << 20),
    (5, 4, 9, False, 0),
])
def test_walk_equals_the_queue(spark, seed, depth, limit, strict, broadcast):
    config = CrawlConfig(depth=depth, page_limit=limit, strict_status=strict, broadcast_bytes=broadcast)
    world = world_with_homes(seed)
    expected = queue_walk(world, config)
    got, _ = spark_walk(spark, world, config)
    assert len(expected) > len(world[3])
    assert got == expected


def test_page_rows(spark):
    world = world_with_homes(7)
    config = CrawlConfig(depth=1)
    _, outcomes = spark_walk(spark, world, config)
    pages, errors = W.pages_of(outcomes), W.page_errors_of(outcomes)
    assert pages.count() + errors.count() == outcomes.count()
    moved = pages.where("Redirected").first()
    assert moved["URL_wayback_machine_processed"] == moved["original_query_URL_wayback_machine"] + "/moved"
    assert moved["downloaded_link"].startswith(moved["website"] + "/p")
    home = pages.where("Depth = 0").first()
    assert (home["n_page_downloaded"], home["nretries_link"], home["n_retries_api"]) == (0, 0, 1)
    assert home["original_query_URL_wayback_machine"] == home["URL_wayback_machine_processed"]
    failed = errors.where("error_message like 'Error_detected: %'").where("Depth = 1").first()
    assert failed["URL_wayback_machine_processed"] == failed["original_query_URL_wayback_machine"]


def test_quota_holds_for_a_hot_site(spark):
    links = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot.com").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias(
            "website"),
        F.lit(2016).alias("year_query"),
        F.col("id").alias("position"),
        F.lit(2).alias("taken"),
        F.col("id").cast("string").alias("link"),
    )
    counts = within_quota(links, 9).groupBy("website").agg(F.count("*").alias("n"), F.min("n_page"), F.max("n_page"))
    assert {tuple(r)[1:] for r in counts.collect()} == {(8, 3, 10)}
    plan = within_quota(links, 9)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_a_level_is_decided_in_one_shuffle(spark):
    schema = "website string, year_query int, url_key string, position int, link string, n_retries_api int"
    found = spark.createDataFrame(
        [("a.com", 2016, f"k{i % 7}", i % 3, f"l{i}", 1) for i in range(30)] + [("b.org", 2015, "k1", 2, "m", 0)], schema
    )
    seen = [("a.com", 2016, "home", 0), ("a.com", 2016, "k2", 1), ("a.com", 2016, "k5", 2), ("b.org", 2015, "x", 0)]
    visited = spark.createDataFrame(seen, "website string, year_query int, url_key string, n_page int")
    rows = next_links(found, visited, 5)
    taken = found.withColumn("taken", F.when(F.col("website") == "a.com", 2).otherwise(0))
    want = within_quota(not_visited(first_per_key(taken), visited), 5)
    columns = ["website", "year_query", "url_key", "position", "link", "n_retries_api", "n_page"]
    assert sorted(rows.select(*columns).collect()) == sorted(want.select(*columns).collect()) != []
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("Initial Plan")].count("Exchange hashpartitioning") <= 1
