import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

from midyear.operators import errors as E
from midyear.operators import merge as M
from midyear.schemas import ERRORS, PAGE_KEY, PAGES
from midyear.sources.tables import (
    read_errors,
    read_pages,
    read_pages_by_part,
    update_pages,
    write_pages_by_part,
    write_table,
)

from .plans import moved_columns

NOW = datetime.datetime(2020, 1, 1)


def page(link, **fields):
    row = dict.fromkeys(PAGES.fieldNames())
    row.update(
        website="ex.com", downloaded_link=link, year_query=2016, original_query_URL_wayback_machine="http://" + link,
        URL_wayback_machine_processed="http://" + link, lastModified=NOW,
    )
    row.update(fields)
    return row


def writes(spark, rows, shapes, schema=PAGES):
    names = schema.fieldNames()
    full = T.StructType([*schema.fields, T.StructField("write_shape", T.StringType()),
                         T.StructField("batch_no", T.IntegerType()), T.StructField("seq", T.IntegerType())])
    data = [(*(r[n] for n in names), shape, 0, i) for i, (r, shape) in enumerate(zip(rows, shapes))]
    return spark.createDataFrame(data, full)


def test_merge_keeps_fields_a_write_does_not_set(spark):
    old = spark.createDataFrame(
        [tuple(page("ex.com/a", n_page_downloaded=4, Title_page="old", n_retries_api=2)[n] for n in PAGES.fieldNames()),
         tuple(page("ex.com/b", Title_page="kept")[n] for n in PAGES.fieldNames())], PAGES)
    new = writes(
        spark,
        [page("ex.com/a", n_page_downloaded=9, Title_page="first", Redirected=True),
         page("ex.com/a", n_page_downloaded=None, Title_page=None, Redirected=False),
         page("ex.com/c", n_page_downloaded=7, Title_page="new")],
        ["walk", "single", "single"],
    )
    got = {r.downloaded_link: r for r in M.merge_pages(old, new).collect()}
    assert set(got) == {"ex.com/a", "ex.com/b", "ex.com/c"}
    # The single-page write sets the title, to null, and leaves the number of the walk.
    assert (got["ex.com/a"].n_page_downloaded, got["ex.com/a"].Title_page, got["ex.com/a"].Redirected) == (9, None, False)
    # The walk did set this field, to null.
    assert got["ex.com/a"].n_retries_api is None
    assert got["ex.com/b"].Title_page == "kept"
    # Only a walk sets the number of a page.
    assert (got["ex.com/c"].n_page_downloaded, got["ex.com/c"].Title_page) == (None, "new")


def test_merge_is_idempotent(spark):
    new = writes(spark, [page("ex.com/a", Title_page="x"), page("ex.com/b")], ["walk", "single"])
    once = M.merge_pages(spark.createDataFrame([], PAGES), new)
    twice = M.merge_pages(once, new)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def odd_pages(spark):
    """A table and a log of writes that share some keys, drawn at random."""
    r = random.Random(8)

    def some(n, **fixed):
        return [page(f"ex.com/{r.randrange(40)}", year_query=2014 + r.randrange(3), website=f"s{r.randrange(5)}.com",
                     Title_page=r.choice([None, "t", "u"]), TextContent=r.choice([None, "", "x" * r.randrange(50)]),
                     n_page_downloaded=r.choice([None, 1, 2]), Redirected=r.choice([None, True]), **fixed) for _ in range(n)]

    old = {tuple(x[k] for k in PAGE_KEY): x for x in some(60)}
    old = spark.createDataFrame([tuple(x[n] for n in PAGES.fieldNames()) for x in old.values()], PAGES)
    new = some(150)
    return old, writes(spark, new, [r.choice(["walk", "single"]) for _ in new])


@pytest.mark.parametrize("bound", [0, 1 << 25])
def test_merge_in_two_phases(spark, bound):
    """Texts take the way of the narrow fields, whether what was decided is broadcast or not."""
    old, new = odd_pages(spark)
    want = sorted(map(str, M.merge_by_key(old, new, PAGE_KEY, M.PAGE_SHAPES).collect()))
    merged = M.merge_pages(old, new, bound)
    assert sorted(map(str, merged.collect())) == want


def test_merge_moves_no_text(spark, tmp_path):
    old, new = odd_pages(spark)
    old.write.parquet(str(tmp_path / "old"))
    new.write.parquet(str(tmp_path / "new"))
    old, new = spark.read.parquet(str(tmp_path / "old")), spark.read.parquet(str(tmp_path / "new"))
    assert "TextContent" not in moved_columns(M.merge_pages(old, new))
    assert "SortAggregate" not in M.merge_pages(old, new)._jdf.queryExecution().executedPlan().toString()
    # Beyond the bound texts move once, and are not sorted.
    large = M.merge_pages(old, new, 0)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan


def test_update_leaves_other_parts_alone(spark, tmp_path):
    old, new = odd_pages(spark)
    path = str(tmp_path / "pages")
    write_pages_by_part(old, path)
    want = sorted(map(str, M.merge_pages(old, new.where("website = 's1.com' and year_query = 2015")).collect()))
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    for _ in range(2):  # a repeated update changes nothing
        update_pages(spark, path, new.where("website = 's1.com' and year_query = 2015"))
        got = read_pages_by_part(spark, path)
        assert sorted(map(str, got.select(*PAGES.fieldNames()).collect())) == want
    after = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    replaced = {p.parent for p in set(before) - set(after)} | {p.parent for p in set(after) - set(before)}
    assert len(replaced) == 1 and len({p.parent for p in before}) > 5
    assert all(after[p] == t for p, t in before.items() if p.parent not in replaced)
    update_pages(spark, path, new.limit(0))
    update_pages(spark, path, new)
    want = sorted(map(str, M.merge_pages(old, new).collect()))
    assert sorted(map(str, read_pages_by_part(spark, path).select(*PAGES.fieldNames()).collect())) == want


def error(original, processed, message, depth=1, flag=None, year=2016):
    row = dict.fromkeys(ERRORS.fieldNames())
    row.update(website="ex.com", year_query=year, original_query_URL_wayback_machine=original,
               URL_wayback_machine_processed=processed, Depth=depth, error_message=message,
               website_not_scrapped=flag, lastModified=NOW)
    return tuple(row[n] for n in ERRORS.fieldNames())


def test_homepage_errors_leave_page_errors_alone(spark):
    old = spark.createDataFrame([error("u", "u", "page"), error("q", None, "home", 0, True)], ERRORS)
    new = writes(spark, [dict(zip(ERRORS.fieldNames(), error("q2", None, "again", 0, True)))], ["homepage"], ERRORS)
    got = {(r.original_query_URL_wayback_machine, r.error_message) for r in M.merge_homepage_errors(old, new).collect()}
    assert got == {("u", "page"), ("q2", "again")}
    scraped = spark.createDataFrame([("ex.com", 2016)], "website string, year_query int")
    assert [r.error_message for r in M.clear_homepage_errors(old, scraped).collect()] == ["page"]


def test_pages_to_retry(spark):
    messages = [None, "No text found", "Error_from_request : status_code : 404", "x status_code: 404",
                "Error_from_request : status_code : 503"]
    rows = [
        error(f"{m}{flag}{depth}", "p", m, depth, flag) for m in messages for flag in (None, True) for depth in (0, 1)
    ]
    got = {r.original_url for r in E.pages_to_retry(spark.createDataFrame(rows, ERRORS)).collect()}
    assert got == {f"{m}None1" for m in (messages[0], messages[3], messages[4])}


def test_coverage_tells_empty_sites_apart(spark):
    """100 seeds: 88 with pages, 10 never entered, 2 entered without any text."""
    names = [f"s{i}.com" for i in range(100)]
    seeds = spark.createDataFrame([(n, 2016) for n in names], "website string, year_query int")
    pages = spark.createDataFrame(
        [tuple(page("l", website=n)[f] for f in PAGES.fieldNames()) for n in names[:88]], PAGES)
    rows = []
    for number, name in enumerate(names[88:]):
        row = dict(zip(ERRORS.fieldNames(), error("q", None, "home", 0, True if number < 10 else None)))
        rows.append(tuple({**row, "website": name}[f] for f in ERRORS.fieldNames()))
    statuses = E.coverage(seeds, pages, spark.createDataFrame(rows, ERRORS)).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in statuses} == {"downloaded": 88, "not_scraped": 10, "empty": 2}


def test_tables_are_never_written_over(spark, tmp_path):
    pages = spark.createDataFrame([tuple(page("ex.com/a")[n] for n in PAGES.fieldNames())], PAGES)
    write_table(pages, str(tmp_path / "pages"))
    assert read_pages(spark, str(tmp_path / "pages")).collect() == pages.collect()
    with pytest.raises(Exception, match="already exists"):
        write_table(pages, str(tmp_path / "pages"))
    write_table(spark.createDataFrame([error("a", "b", "m")], ERRORS), str(tmp_path / "errors"))
    assert read_errors(spark, str(tmp_path / "errors")).count() == 1
