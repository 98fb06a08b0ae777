"""Whole runs against plain dictionaries, one page at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from midyear import CrawlConfig
from midyear.plans.runs import run
from midyear.schemas import RESPONSES
from midyear.sources.captures import Archive
from midyear.sources.tables import empty_errors, empty_pages
from tests.test_walk import key_of, make_world, page_table, queue_walk

FAILED = "Domain not scraped at all because we do not access to the closest url returned by WaybackMachine API, "
THROTTLE = "https://web.archive.org/429.html"


def make_rounds(seed, rounds=4):
    """One world whose failing URLs answer after a number of rounds, some never."""
    responses, links, texts, homes = make_world(seed)
    rng = random.Random(seed)
    lag = {r[0]: rng.choice([0, 0, 1, 2, 9]) for r in responses}
    kinds = {r[0]: rng.choice(["none", "503", "404", "429"]) for r in responses}
    worlds = []
    for now in range(rounds):
        rows = []
        for url, _, _, final, content, moved, _ in responses:
            kind = kinds[url] if lag[url] > now else "ok"
            status = {"none": None, "503": 503, "404": 404}.get(kind, 200)
            rows.append((
                url, status, "Error_detected: x" if status is None else None,
                THROTTLE if kind == "429" else final, content, moved, now,
            ))
        worlds.append((rows, links, texts, homes))
    return worlds


def plain_run(worlds, config):
    flagged, failed, pages, counts = {}, {}, {}, ([], [])
    homes = {(s, y): u for s, y, u in worlds[0][3]}
    text_of = {t[0]: t[2] for t in worlds[0][2]}

    def refusal(got):
        if got is None or got[1] is None:
            return got[2] if got else "Error_detected: no stored response"
        if got[1] == 200 and got[3] == THROTTLE:
            return FAILED + "Error 429 : " + THROTTLE
        return got[1] != 200 and FAILED + f"status_code: {got[1]}"

    def crawl(seeds, world):
        answer = {r[0]: r for r in world[0]}
        opened = []
        for seed in seeds:
            message = refusal(answer.get(homes[seed]))
            if message:
                flagged[seed] = message
            else:
                flagged.pop(seed, None)
                opened.append((*seed, homes[seed]))
        rows = queue_walk((*world[:3], opened), config)
        for site, year, depth, number, asked, error, landed in sorted(rows, key=lambda r: r[3]):
            if error:
                failed[site, year, asked, landed] = (depth, error)
            else:
                pages[site, key_of(landed, site), year, asked, landed] = (number, depth, answer_text(asked, landed, homes))

    def answer_text(asked, landed, homes):
        url = asked if asked in text_of else asked.removesuffix("/moved")
        return text_of[url]

    def single(keys, world):
        answer = {r[0]: r for r in world[0]}
        for key in keys:
            site, year, asked, landed = key
            got, depth = answer.get(landed), failed[key][0]
            if got is None or got[1] is None:
                failed[key] = (depth, "Error_retry_acces : message : " + refusal(got))
            elif got[3] == THROTTLE and got[1] == 200:
                failed[key] = (depth, refusal(got))
            elif got[1] != 200:
                failed[key] = (depth, f"Error_from_request : status_code : {got[1]}")
            elif "text" not in got[4]:
                failed[key] = (depth, f"Error_detected: in access url : {got[3]} \t status code: 200")
            elif not text_of[landed]:
                failed[key] = (depth, "No text found")
            else:
                del failed[key]
                place = (site, key_of(landed, site), year, asked, landed)
                pages[place] = (pages.get(place, (None,))[0], depth, text_of[landed])

    def retriable():
        return [
            k for k, (depth, m) in failed.items()
            if m != "No text found" and not re.search("status_code : 40[0-9]", m) and depth == 1
        ]

    def settle(current, again, log):
        before, rounds = 0, 0
        while True:
            todo = current()
            log.append(len(todo))
            if len(todo) in (0, before):
                return
            again(todo, worlds[1:][min(rounds, len(worlds) - 2)])
            before, rounds = len(todo), rounds + 1

    crawl(list(homes), worlds[0])
    settle(lambda: list(flagged), crawl, counts[0])
    settle(retriable, single, counts[1])
    return flagged, failed, pages, counts


@pytest.mark.parametrize("seed", [11, 12])
def test_run_equals_the_dictionaries(spark, seed):
    worlds = make_rounds(seed)
    config = CrawlConfig(depth=1, page_limit=8)
    flagged, failed, pages, counts = plain_run(worlds, config)
    archives = [
        Archive(
            times=spark.createDataFrame(
                [(s, u, u.split("/web/")[1][:14]) for s, _, u in homes], "site string, url string, ts14 string"
            ).withColumn("captured_at", F.try_to_timestamp("ts14", F.lit("yyyyMMddHHmmss"))),
            responses=spark.createDataFrame(responses, RESPONSES),
            pages=page_table(spark, links, texts),
        )
        for responses, links, texts, homes in worlds
    ]
    seeds = spark.createDataFrame([h[:2] for h in worlds[0][3]], "website string, year_query int")
    done = run(seeds, archives, empty_errors(spark), config)
    assert (done.homepage_counts, done.page_counts) == counts
    assert counts[0][0] > 0 and counts[1][0] > 0
    got_pages = {
        (r.website, r.downloaded_link, r.year_query, r.original_query_URL_wayback_machine,
         r.URL_wayback_machine_processed): (r.n_page_downloaded, r.Depth, r.TextContent)
        for r in done.pages(empty_pages(spark)).collect()
    }
    assert got_pages == pages
    errors = done.errors.collect()
    assert {(r.website, r.year_query): r.error_message for r in errors if r.website_not_scrapped} == flagged
    got_failed = {
        (r.website, r.year_query, r.original_query_URL_wayback_machine, r.URL_wayback_machine_processed):
            (r.Depth, r.error_message)
        for r in errors if not r.website_not_scrapped
    }
    assert got_failed == failed
