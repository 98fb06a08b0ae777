import shutil
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from midyear import CrawlConfig
from midyear import constants as K
from midyear.operators import joins
from midyear.operators.attempts import compacted, resolve_rounds
from midyear.plans.crawl import crawl, locate
from midyear.plans.single_page import single_pages
from midyear.schemas import ATTEMPTS
from midyear.session import store
from midyear.sources import lists as L
from midyear.sources.captures import (
    Archive,
    checked,
    merge_attempts,
    open_archive,
    read_archive,
    read_captures,
    read_certificate,
    reject_repeated_urls,
    write_archive,
)
from verification import views

from .plans import moved_columns


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_seed_lines(spark):
    given = lines(
        spark, "sweetorigins.com, 2015", "e-mov.cl, 2018\t", " mia-ben.com, 2016", "", "a.com", "a.com,2015",
        "a.com, x", "a.com, 2015, 1",
    )
    assert sorted(map(tuple, L.parse_seeds(given).collect())) == [
        ("e-mov.cl", 2018), ("mia-ben.com", 2016), ("sweetorigins.com", 2015)]
    assert {r.value for r in L.bad_seed_lines(given).collect()} == {
        "", "a.com", "a.com,2015", "a.com, x", "a.com, 2015, 1"}


def test_lists_round_trip(spark, tmp_path):
    seeds = spark.createDataFrame([("a.com", 2015), ("b.org", 2016)], "website string, year_query int")
    L.write_lines(L.seed_lines(seeds), str(tmp_path / "seeds"))
    back = L.parse_seeds(L.read_lines(spark, str(tmp_path / "seeds")))
    assert sorted(back.collect()) == sorted(seeds.collect())
    rows = spark.createDataFrame(
        [("a.com", 2016, "http://a.com/x y\n", "http://a.com/z", 1), ("b.org", 2016, None, "u", 1)],
        "website string, year_query int, original_url string, processed_url string, depth int",
    )
    L.write_lines(L.retry_page_lines(rows), str(tmp_path / "pages"))
    back = L.parse_retry_pages(L.read_lines(spark, str(tmp_path / "pages"))).collect()
    assert [tuple(r) for r in back] == [("a.com", 2016, "http://a.com/xy", "http://a.com/z", 1)]
    assert [r.website for r in L.rows_without_url(rows).collect()] == ["b.org"]
    assert L.bad_retry_lines(lines(spark, "a, 2016, b, c", "a, x, b, c, 1", "a, 2016, b, c, 1")).count() == 2


def test_lines_are_numbered_across_files_and_blocks(spark, tmp_path):
    (tmp_path / "list").mkdir()
    want = []
    for number, name in enumerate(["b.txt", "a.txt", "c.txt"]):
        (tmp_path / "list" / name).write_text("\n".join(f"{name}{i}" + "x" * (i % 9) for i in range(400 * number + 1)) + "\n")
    for name in ("a.txt", "b.txt", "c.txt"):
        want += (tmp_path / "list" / name).read_text().splitlines()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = L.read_numbered_lines(spark, str(tmp_path / "list")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in sorted(lines, key=lambda r: r.line_no)] == want
    assert sorted(r.line_no for r in lines) == list(range(len(want)))


def test_stored_ends_locate_without_captures(spark, tiny, tmp_path):
    write_archive(views.captures(spark, tiny), str(tmp_path / "archive"))
    archive = open_archive(spark, str(tmp_path / "archive"))
    seeds = views.seeds(spark, tiny)
    located = locate(seeds, archive)
    assert sorted(map(str, located.collect())) == sorted(map(str, locate(seeds, replace(archive, ends=None)).collect()))
    read = [line for line in located._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert any("span#" in line for line in read) and not any("ts14" in line for line in read)


def test_stored_archive_gives_the_same_crawl(spark, tiny, tmp_path):
    captures = views.captures(spark, tiny)
    write_archive(captures, str(tmp_path / "archive"))
    stored = read_archive(spark, str(tmp_path / "archive"))
    assert "html" not in stored.columns
    seeds = views.seeds(spark, tiny)

    def rows(archive, bound=32 << 20):
        pages = crawl(seeds, archive, CrawlConfig(broadcast_bytes=bound)).pages.drop("lastModified", "snapshot_date")
        return sorted(map(str, pages.collect()))

    want = rows(Archive.of(captures))
    assert want and rows(Archive.of(stored)) == want
    opened = open_archive(spark, str(tmp_path / "archive"))
    assert opened.buckets and rows(opened) == want and rows(opened, 0) == want and rows(Archive.of(captures), 0) == want


def test_no_text_moves_whatever_the_bound(spark, tiny, tmp_path, monkeypatch):
    """Pages are met in their buckets, or where they are read; neither HTML nor text is shuffled or broadcast."""
    write_archive(views.captures(spark, tiny), str(tmp_path / "archive"), buckets=6)
    archive = open_archive(spark, str(tmp_path / "archive"))
    monkeypatch.setattr(joins, "FEW_URLS", 0)
    for bound in (0, 32 << 20):
        config = CrawlConfig(broadcast_bytes=bound)
        done = crawl(views.seeds(spark, tiny), archive, config)
        moved = moved_columns(done.outcomes)
        assert {"url", "status"} <= moved and not moved & {"html", "text", "title", "hrefs"}
        again = single_pages(views.retry_rows(spark, tiny), archive, config).outcomes
        assert not moved_columns(again) & {"html", "text", "title", "hrefs"}
    plan = done.outcomes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    large = crawl(views.seeds(spark, tiny), archive, CrawlConfig(broadcast_bytes=0)).outcomes
    assert "SelectedBucketsCount: 6 out of 6" in large._jdf.queryExecution().executedPlan().toString()


def test_few_urls_read_few_buckets(spark, tiny, tmp_path):
    """Files of other buckets may be unreadable."""
    path = tmp_path / "archive"
    write_archive(views.captures(spark, tiny), str(path), buckets=16)
    archive = open_archive(spark, str(path))
    some = store(archive.responses.orderBy("url").limit(2), "url")
    want = {r.url for r in some.rows.collect()}
    buckets = {
        f"_{r.b:05d}.c000" for r in some.rows.select(F.expr("pmod(hash(url), 16)").alias("b")).collect()
    }
    spoiled = 0
    for file in path.glob("part-*.parquet"):
        if not any(b in file.name for b in buckets):
            file.write_bytes(b"x" * file.stat().st_size)
            spoiled += 1
        (path / f".{file.name}.crc").unlink(missing_ok=True)
    assert spoiled > 5
    assert {r.url for r in archive.texts_of(some.keys, 1 << 20).collect()} == want
    assert {r.url for r in archive.responses_of(some.keys, 1 << 20).collect()} == want


def test_a_broken_archive_is_refused(spark, tiny, tmp_path):
    path = tmp_path / "archive"
    write_archive(views.captures(spark, tiny), str(path), buckets=4)
    assert read_certificate(spark, str(path)).n_rows == read_archive(spark, str(path)).count()
    whole = shutil.copytree(path, tmp_path / "copy")
    next(whole.glob("part-*.parquet")).unlink()
    with pytest.raises(ValueError, match="broken"):
        open_archive(spark, str(whole))
    for part in (path / "_certificate").glob("*"):
        part.unlink()
    (path / "_certificate").rmdir()
    with pytest.raises(ValueError, match="no certificate"):
        read_archive(spark, str(path))
    with pytest.raises(ValueError, match="captures lack"):
        open_archive(spark, str(path))


def test_captures_have_a_schema(spark, tiny, tmp_path):
    captures = views.captures(spark, tiny)
    captures.withColumn("status", F.col("status").cast("string")).write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(ValueError, match="captures lack status int"):
        read_captures(spark, str(tmp_path / "wrong"))
    captures.write.parquet(str(tmp_path / "right"))
    assert "page_id" not in read_captures(spark, str(tmp_path / "right")).columns


def test_captures_that_repeat_urls_are_refused(spark, tiny):
    captures = views.captures(spark, tiny)
    with pytest.raises(ValueError, match="more than one capture"):
        Archive.of(captures.unionByName(captures))


def test_compacted_logs_decide_alike(spark, tiny):
    """Whatever a log is compacted to on the way, the responses chosen in the end are those of the whole log."""
    log = views.attempt_log(spark, tiny)
    columns = ["transport_error", "final_url", "attempt"]

    def decided(some):
        return sorted(map(str, resolve_rounds(some, "url", columns, 3).collect()))

    want = decided(log)
    first, second = log.where("attempt <= 2 and round = 1"), log.where("not (attempt <= 2 and round = 1)")
    assert decided(compacted(log, "url", 3)) == want
    assert decided(compacted(compacted(first, "url", 3).unionByName(second), "url", 3)) == want
    assert compacted(log, "url", 3).groupBy("url").count().agg(F.max("count")).first()[0] <= 4


def test_log_grows_in_its_buckets(spark, tiny, tmp_path):
    log = checked(views.attempt_log(spark, tiny), ATTEMPTS)
    first = merge_attempts([log.where("round = 1")], str(tmp_path / "a"), buckets=4)
    both = merge_attempts([first, log.where("round = 2")], str(tmp_path / "b"), buckets=4)
    want, got = Archive.of_attempts(log, 3), Archive.of_attempts(both, 3)
    assert sorted(map(str, want.responses.collect())) == sorted(map(str, got.responses.collect()))
    keys = store(want.responses, "url").keys
    assert sorted(map(str, want.texts_of(keys, 1 << 20).collect())) == sorted(map(str, got.texts_of(keys, 0).collect()))


def test_archive_reads_only_what_a_job_needs(spark, tiny, tmp_path):
    write_archive(views.captures(spark, tiny), str(tmp_path / "archive"))
    archive = open_archive(spark, str(tmp_path / "archive"))
    plan = archive.times.groupBy("site").agg(F.max("captured_at"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<site:string,ts14:string>" in plan


def test_pages_are_picked_before_they_are_parsed(spark, tiny, tmp_path):
    views.captures(spark, tiny).write.parquet(str(tmp_path / "captures"))
    archive = open_archive(spark, str(tmp_path / "captures"))
    wanted = store(archive.responses.where("status = 404"), "url").keys
    for found in (archive.links_of(wanted, 1 << 20), archive.texts_of(wanted, 1 << 20)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract_all") > 0
        assert "regexp_extract_all" not in plan[plan.index("LeftSemi"):]
        assert "BroadcastHashJoin" in plan
    # For a set over the bound all pages are parsed once, and met in their buckets.
    large = archive.texts_of(wanted, 0)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "BroadcastHashJoin" not in plan
    assert sorted(large.collect()) == sorted(archive.texts_of(wanted, 1 << 20).collect())
    assert archive.parsed() is archive.parsed()


def test_an_archive_has_one_capture_per_url(spark, tiny, tmp_path):
    captures = views.captures(spark, tiny)
    with pytest.raises(ValueError, match="more than one capture"):
        write_archive(captures.unionByName(captures), str(tmp_path / "twice"))


def test_archive_of_attempts(spark):
    """One response per URL, with the body of the attempt that won; a throttled round gives way to the second."""
    schema = (
        "site string, ts14 string, url string, round int, attempt int, status int, transport_error string,"
        " final_url string, content_type string, n_redirects int, html string"
    )

    def row(url, round_, attempt, status, final=None, html=None):
        return ("a.de", "20160701000000", url, round_, attempt, status, None, final, None, 0, html)

    log = spark.createDataFrame([
        row("u", 1, 1, 503, "u", "busy"), row("u", 1, 2, 200, "u", "second"), row("u", 1, 3, 200, "u", "third"),
        row("v", 1, 1, 503, "v", "one"), row("v", 1, 2, 503, "v", "two"), row("v", 1, 3, 200, "v", "beyond"),
        row("w", 1, 1, 200, K.THROTTLE_PAGE, "slow down"), row("w", 2, 1, 200, None, "later"),
    ], schema)
    archive = Archive.of_attempts(log, attempts=2)
    assert {(r.url, r.status, r.final_url, r.n_retries) for r in archive.responses.collect()} == {
        ("u", 200, "u", 1), ("v", 503, "v", 2), ("w", 200, "w", 0),
    }
    chosen = archive.pages.join(archive.chosen, ["url", "round", "attempt"]).select("url", "html")
    assert {tuple(r) for r in chosen.collect()} == {("u", "second"), ("v", "two"), ("w", "later")}
    assert archive.times.count() == 3
    reject_repeated_urls(log)
    with pytest.raises(ValueError):
        reject_repeated_urls(log.unionByName(log))
