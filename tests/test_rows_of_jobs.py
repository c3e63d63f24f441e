"""Jobs lose and multiply no rows: null and repeated ids, posts without a time, dates as people type them."""

import datetime as dt

import pytest

from tidepost.plans import jobs, work

KIND = "post_id long, text string, url string, ts timestamp_ntz, lang string, is_reply boolean"
DAY = dt.datetime(2024, 1, 10)


def post(i, url, ts=DAY, text=None):
    return (i, text or f"banjir besar di kota hari ini nomor {url}", url, ts, "id", False)


ROWS = [post(1, "a"), post(None, "b"), post(4, "c"), post(4, "d"), post(4, "d"), post(5, "e", None), post(None, "f", None), post(6, None), post(7, "")]


@pytest.fixture
def posts(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.mark.parametrize("dates,wanted", [(("2024-01-01", "2024-02-01"), "abcd"), (("2024-1-1", "2024-2-1"), "abcd"), (("soon", "later"), "abcdef")])
@pytest.mark.parametrize("count", [0, 1000])
def test_expand_job_keeps_every_match_once(posts, dates, wanted, count):
    found = jobs.expand_job(posts, ["banjir"], *dates, asof="2024-03-01", count=count, unlimited=not count).collect()
    assert sorted(r.url for r in found) == list(wanted)
    assert {(r.post_id, r.url) for r in found} <= {(r[0], r[2]) for r in ROWS}


def test_expand_job_cap_with_tied_order(posts):
    found = [jobs.expand_job(posts.repartition(n), ["banjir"], "2024-01-01", "2024-02-01", "2024-03-01", 3).collect() for n in (1, 5)]
    assert len(found[0]) == 3 and sorted(found[0], key=str) == sorted(found[1], key=str)


def test_undated_items_reach_posts_without_a_time(spark, posts):
    items = spark.createDataFrame(
        [(0, 0, "banjir", 0, "x", "y"), (1, 0, "banjir", 1, "2024-01-10", "2024-01-11"), (2, 1, "lainnya", 0, None, None)],
        "work_idx int, variation_idx int, variation string, chunk_idx int, chunk_start string, chunk_end string",
    )
    for undated in (True, False):
        found = work.match_posts(posts, items, undated=undated, keep=["url"]).collect()
        everywhere = sorted((str(r[2]) for r in ROWS)) if undated else []
        assert sorted(str(r.url) for r in found if r.work_idx == 0) == everywhere
        assert sorted(str(r.url) for r in found if r.work_idx == 1) == sorted(str(r[2]) for r in ROWS if r[3])
        assert not [r for r in found if r.work_idx == 2]
    assert work.match_posts(posts.where("false"), items, undated=True, keep=["url"]).count() == 0


@pytest.mark.parametrize("dates", [("2024-1-1", "2024-1-31"), ("2024-01-01", "2024-01-31"), (" 2024-1-01", "2024-01-31 ")])
def test_standard_job_reads_dates_without_zeros(posts, dates):
    found = jobs.standard_job(posts, ["banjir"], *dates, None).collect()
    assert sorted(r.url for r in found) == ["a", "b", "c", "d"]


def test_standard_job_with_unreadable_dates_is_one_search(posts):
    found = jobs.standard_job(posts, ["banjir"], "soon", "2024-01-31", None).collect()
    assert {r.url for r in found} == {"a", "b", "c", "d", "e", "f", None, ""}


def test_row_key_tells_rows_apart(spark):
    rows = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), (None, None), ("a", "a")], "x string, y string")
    keys = [tuple(r) for r in rows.select(*jobs.row_key(rows)).collect()]
    assert len(set(keys)) == 4 and keys[2] == keys[4]


def broadcast_bytes(plan) -> int:
    """Bytes of the largest table that a finished plan broadcast."""
    name = plan.nodeName()
    own = plan.metrics().get("dataSize").get().value() if name == "BroadcastExchange" else 0
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else []
    children = plan.children()
    return max([own, *map(broadcast_bytes, inner + [children.apply(i) for i in range(children.size())])])


def test_the_plan_is_not_multiplied_by_the_days_of_its_ranges(spark, tmp_path):
    names = spark.range(40).selectExpr("CAST(id AS INT) AS variation_idx", "concat('wort', id, ' gross') AS variation")
    ends = [(i, dt.date(2020, 1, 1) + dt.timedelta(500 * i), dt.date(2020, 1, 1) + dt.timedelta(500 * i + 500)) for i in range(2)]
    chunks = spark.createDataFrame(ends, "chunk_idx int, chunk_start date, chunk_end date")
    items = names.crossJoin(chunks).selectExpr("variation_idx * 2 + chunk_idx AS work_idx", "*")
    items.write.parquet(f"{tmp_path}/items")
    stored = spark.read.parquet(f"{tmp_path}/items")
    rows = [(i, f"Wort{i % 50} ist", dt.datetime(2019, 12, 30) + dt.timedelta(days=i)) for i in range(1010)]
    posts = spark.createDataFrame(rows, "post_id long, text string, ts timestamp")
    found = work.match_posts(posts, stored, keep=["post_id"])
    got = sorted((r.work_idx, r.post_id) for r in found.collect())
    # wort1 is in wort10 to wort19 too
    wanted = [
        (v * 2 + c, i) for v in range(40) for c in range(2) for i, text, _ in rows
        if f"wort{v}" in text.lower() and 0 <= i - 2 - 500 * c < 500
    ]
    assert got == sorted(wanted)
    # once 16,000 rows, of each day and salt, held 40 items each
    assert broadcast_bytes(found._jdf.queryExecution().executedPlan()) < 4 << 20
    shuffled = work.match_posts(posts, stored, keep=["post_id"], most_bytes=0)
    assert sorted((r.work_idx, r.post_id) for r in shuffled.collect()) == got
    assert broadcast_bytes(shuffled._jdf.queryExecution().executedPlan()) == 0
