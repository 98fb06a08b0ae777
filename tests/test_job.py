import pytest
from pyspark.sql import functions as F

from midyear.operators.errors import pages_to_retry
from midyear.operators.nearest import nearest_capture
from midyear.plans.crawl import NO_ANSWER
from midyear.plans.job import run_answers_job, run_job, run_pages_job
from midyear.plans.single_page import single_pages
from midyear.schemas import PAGE_ERROR_KEY, PAGE_KEY
from midyear.sources.captures import Archive, capture_times, write_archive
from midyear.sources.lists import parse_retry_pages, parse_seeds, retry_page_lines, seed_lines, write_lines
from midyear.sources.tables import read_errors, read_pages, write_table
from verification import views


def test_job_goes_on_from_an_earlier_run(spark, tiny, tmp_path):
    for healed in (0, 2):
        write_archive(views.captures(spark, tiny, healed), str(tmp_path / f"archive{healed}"))
    write_lines(seed_lines(views.seeds(spark, tiny)), str(tmp_path / "seeds"))

    first = str(tmp_path / "first")
    done = run_job(spark, str(tmp_path / "seeds"), [str(tmp_path / "archive0")], first)
    # Nothing new to fetch from: the second count equals the first and the loop ends.
    assert done.homepage_counts[0] == done.homepage_counts[-1] > 0
    listed = spark.read.text(first + "/retry_homepages")
    assert parse_seeds(listed).count() == listed.count() == done.homepage_counts[-1]
    stored = read_pages(spark, first + "/pages").count()
    assert stored > 0

    second = str(tmp_path / "second")
    run_job(
        spark, str(tmp_path / "seeds"), [str(tmp_path / "archive2")], second, first + "/pages", first + "/errors"
    )
    flagged = [read_errors(spark, path + "/errors").where("website_not_scrapped").count() for path in (first, second)]
    assert flagged[1] < flagged[0]
    pages = read_pages(spark, second + "/pages")
    assert pages.count() > stored
    assert pages.select("website", "year_query", "URL_wayback_machine_processed",
                        "original_query_URL_wayback_machine").distinct().count() == pages.count()


def test_job_over_a_page_list(spark, tiny, tmp_path):
    captures = views.captures(spark, tiny)
    write_archive(captures, str(tmp_path / "archive"))
    lines = retry_page_lines(views.retry_rows(spark, tiny))
    write_lines(lines.union(spark.createDataFrame([("no page",)], "value string")), str(tmp_path / "listed"))
    output = str(tmp_path / "output")
    run_pages_job(spark, str(tmp_path / "listed"), str(tmp_path / "archive"), output)
    assert [r.value for r in spark.read.text(output + "/bad_lines").collect()] == ["no page"]

    done = single_pages(parse_retry_pages(lines).distinct(), Archive.of(captures)).stored()
    assert read_pages(spark, output + "/pages").count() == done.pages.select(*PAGE_KEY).distinct().count() > 0
    errors = read_errors(spark, output + "/errors")
    assert errors.count() == done.errors.select(*PAGE_ERROR_KEY).distinct().count() > 0
    # What can be fetched again leaves as a list.
    failed = pages_to_retry(errors)
    assert spark.read.text(output + "/retry_pages").count() == failed.count()
    assert spark.read.parquet(output + "/retry_without_url").count() == 0
    assert spark.read.text(output + "/retry_homepages").count() == 0


def test_job_over_stored_answers(spark, tiny, tmp_path):
    """Answers that name the nearest captures give the pages of a crawl of the seeds."""
    captures = views.captures(spark, tiny)
    write_archive(captures, str(tmp_path / "archive"))
    nearest = nearest_capture(views.seeds(spark, tiny), capture_times(captures))
    body = F.concat(F.lit('{"archived_snapshots": {"closest": {"url": "'), "capture_url", F.lit('"}}}'))
    located = views.seeds(spark, tiny).distinct().join(nearest, ["website", "year_query"], "left")
    answers = located.select("website", "year_query", F.coalesce(body, F.lit(NO_ANSWER)).alias("body"))
    write_table(answers, str(tmp_path / "answers"))
    write_lines(seed_lines(views.seeds(spark, tiny)), str(tmp_path / "seeds"))
    by_answers, by_seeds = str(tmp_path / "by_answers"), str(tmp_path / "by_seeds")
    run_answers_job(spark, str(tmp_path / "answers"), [str(tmp_path / "archive")], by_answers)
    run_job(spark, str(tmp_path / "seeds"), [str(tmp_path / "archive")], by_seeds)

    def rows(read, path):
        return sorted(map(str, read(spark, path).drop("lastModified").collect()))

    assert rows(read_pages, by_answers + "/pages") == rows(read_pages, by_seeds + "/pages") != []
    assert rows(read_errors, by_answers + "/errors") == rows(read_errors, by_seeds + "/errors")


def test_job_refuses_captures_stored_twice(spark, tiny, tmp_path):
    captures = views.captures(spark, tiny)
    captures.union(captures).write.parquet(str(tmp_path / "captures"))
    write_lines(seed_lines(views.seeds(spark, tiny)), str(tmp_path / "seeds"))
    with pytest.raises(ValueError, match="more than one capture"):
        run_job(spark, str(tmp_path / "seeds"), [str(tmp_path / "captures")], str(tmp_path / "output"))
