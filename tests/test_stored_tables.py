"""The ledger's generations, records of pages in SQL, posts by day: rows, hard inputs and files read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepost.plans import work
from tidepost.sources.days import days_per_folder, in_days_of, read_days, write_by_day
from tidepost.sources.ledger import Ledger
from tidepost.sources.page_function import parse_fields, register_page_records

DONE = "work_idx long, fetched long, new_unique long"


def test_a_forgotten_run_stays_forgotten_whatever_the_clocks_say(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    later = spark.createDataFrame([(1, 5, 5)], DONE).withColumn("saved_at", F.lit("2999-01-01").cast("timestamp"))
    ledger.save("a", later)
    assert ledger.exists("a") and not ledger.exists("b")
    ledger.delete("a")
    assert not ledger.exists("a")
    ledger.save("a", spark.createDataFrame([(2, 1, 1), (2, 3, 0)], DONE))
    assert [tuple(r) for r in ledger.load("a").collect()] == [(2, 3, 1)]
    ledger.delete("a")
    ledger.delete("a")
    ledger.save("a", spark.createDataFrame([(7, 0, 0)], DONE))
    assert ledger.highest("a").first()[0] == 7 and ledger.load("a").count() == 1


def test_page_records_in_sql(spark):
    register_page_records(spark)
    page = '<ul><li><a href="/1">One</a> more</li><li>no link</li><li><a>Two</a></li></ul>'
    spark.createDataFrame([(1, page), (2, None), (3, ""), (1, page)], "id int, html string").createOrReplaceTempView("some_pages")
    sql = "SELECT p.id, r.* FROM some_pages p, LATERAL page_records(p.html, 'li', '{}') r"
    found = spark.sql(sql.format("title=a; url=a@href; body=."))
    assert found.columns == ["id", "pos", "title", "url", "body"]
    rows = [(1, 0, "One", "/1", "One more"), (1, 1, None, None, "no link"), (1, 2, "Two", None, "Two")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows * 2, key=str)
    assert spark.sql(sql.format("only=.")).columns == ["id", "pos", "only"]
    for bad in ("title", "=a", "pos=a", "a=x;a=y", "a="):
        with pytest.raises(ValueError):
            parse_fields(bad)
        with pytest.raises(Exception):
            spark.sql(sql.format(bad)).collect()
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM some_pages p, LATERAL page_records(p.html, 'li', p.html) r").collect()


def files_read(plan) -> int:
    """Files that the scans of a finished plan opened."""
    own = 0
    name = plan.nodeName()
    if name.startswith("Scan parquet"):
        own = plan.metrics().get("numFiles").get().value()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else []
    children = plan.children()
    return own + sum(map(files_read, inner + [children.apply(i) for i in range(children.size())]))


def test_files_read_fall_with_the_days_asked_for(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"banjir {i}", start + dt.timedelta(days=i % 40, hours=i % 24) if i % 41 else None) for i in range(400)]
    posts = spark.createDataFrame(rows, "post_id long, text string, ts timestamp_ntz")
    write_by_day(posts, f"{tmp_path}/days")
    assert len(list((tmp_path / "days").glob("day=*/*.parquet"))) == 41
    kind = "work_idx int, variation_idx int, variation string, chunk_idx int, chunk_start string, chunk_end string"
    for days in (1, 5, 40):
        end = (start + dt.timedelta(days=days)).date().isoformat()
        items = spark.createDataFrame([(0, 0, "banjir", 0, "2024-01-01", end), (1, 0, "banjir", 1, "odd", end)], kind)
        stored = read_days(spark, f"{tmp_path}/days", posts.schema)
        asked = in_days_of(stored, items)
        got = sorted(r.post_id for r in asked.collect())
        assert got == [i for i, _, ts in rows if ts and ts < start + dt.timedelta(days=days)]
        assert files_read(asked._jdf.queryExecution().executedPlan()) == days
        want = work.match_posts(posts, items, keep=["post_id"])
        assert sorted(work.match_posts(asked, items, keep=["post_id"]).collect()) == sorted(want.collect())
    assert in_days_of(stored, items, undated=True).count() == 400
    assert in_days_of(stored, items.where("work_idx = 1")).count() == 0


def test_a_long_span_is_stored_in_few_folders(spark, tmp_path):
    start = dt.datetime(1969, 12, 25)  # days before 1970 too
    rows = [(i, f"banjir {i}", start + dt.timedelta(days=i) if i % 41 else None) for i in range(400)]
    posts = spark.createDataFrame(rows, "post_id long, text string, ts timestamp_ntz")
    days = days_per_folder("1969-12-25", (start + dt.timedelta(days=400)).date().isoformat(), most=20)
    assert days == 20 and days_per_folder("2024-01-01", "2024-01-01") == 1
    write_by_day(posts, f"{tmp_path}/days", days=days)
    assert len(list((tmp_path / "days").glob("day=*/*.parquet"))) <= 22  # one more for null
    stored = read_days(spark, f"{tmp_path}/days", posts.schema)
    kind = "work_idx int, variation_idx int, variation string, chunk_idx int, chunk_start string, chunk_end string"
    for first, last in ((0, 1), (3, 30), (395, 500), (0, 400)):
        a, b = start + dt.timedelta(days=first), start + dt.timedelta(days=last)
        items = spark.createDataFrame([(0, 0, "banjir", 0, a.date().isoformat(), b.date().isoformat())], kind)
        asked = in_days_of(stored, items, days=days)
        assert asked.columns == posts.columns
        assert sorted(r.post_id for r in asked.collect()) == [i for i, _, ts in rows if ts and a <= ts < b]
        assert files_read(asked._jdf.queryExecution().executedPlan()) <= (last - first) / days + 2
