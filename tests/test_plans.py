"""Dates, work items, limits, dedup, rates, running totals: boundaries and skew."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepost.functions import dates as D
from tidepost.operators import dedup, discovery, limits, ranking, rates, running, stalls
from tidepost.plans import fill, work

DAY = dt.date


def chunks(spark, column):
    return [tuple(c) for c in spark.range(1).select(column.alias("c")).first().c]


def lit(day):
    return F.lit(day).cast("date")


@pytest.mark.parametrize(
    "column, count, last",
    [
        (lambda: D.trailing_chunks(lit("2026-01-18"), 60), 9, ("2026-01-14", "2026-01-18")),
        (lambda: D.adaptive_chunks(lit("2024-01-01"), lit("2025-12-31")), 25, ("2025-12-21", "2025-12-31")),
        (lambda: D.trailing_chunks(lit("2026-01-20"), 120), 18, ("2026-01-19", "2026-01-20")),
        (lambda: D.adaptive_chunks(lit("2024-01-01"), lit("2024-03-01")), 9, ("2024-02-26", "2024-03-01")),
    ],
)
def test_recorded_chunk_tables(spark, column, count, last):
    found = chunks(spark, column())
    assert len(found) == count
    assert tuple(map(str, found[-1][1:])) == last
    assert [c[0] for c in found] == list(range(count))
    assert all(a[2] == b[1] for a, b in zip(found, found[1:]))


def test_chunk_edges(spark):
    assert chunks(spark, D.date_chunks(lit("2024-01-01"), lit("2024-01-01"))) == []
    assert chunks(spark, D.date_chunks(lit("2024-01-02"), lit("2024-01-01"))) == []
    assert chunks(spark, D.date_chunks(lit(None), lit("2024-01-01"))) == []
    assert len(chunks(spark, D.weekly_chunks_if_long(lit("2024-01-01"), lit("2024-01-08")))) == 1
    assert len(chunks(spark, D.weekly_chunks_if_long(lit("2024-01-01"), lit("2024-01-09")))) == 2
    raw = D.planned_chunks(F.lit("x"), F.lit("2024-01-01"), lit("2024-01-01"))
    assert chunks(spark, raw) == [(0, "x", "2024-01-01")]
    spans = [60, 61, 180, 181]
    days = [D.adaptive_days(lit("2024-01-01"), F.date_add(lit("2024-01-01"), s)) for s in spans]
    assert list(spark.range(1).select(*days).first()) == [7, 14, 14, 30]


def test_quota_formulas(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    def quota(count, items=54, dates=True):
        return one(D.planned_quota(F.lit(count), F.lit(items), F.lit(dates)))

    assert (quota(100), quota(9000), quota(0), quota(0, dates=False), quota(10000)) == (30, 200, 200, 200, 200)
    rest = [one(D.remaining_quota(F.lit(t), F.lit(0), F.lit(10))) for t in (1000, 100, 0)]
    assert rest == [100, 50, 0]
    levels = [one(D.rate_level(F.lit(n), 20, 25)) for n in (19, 20, 24, 25)]
    assert levels == ["COOL", "WARM", "WARM", "HOT"]
    assert [one(D.rate_percent(F.lit(n), 30)) for n in (1, 29, 31)] == [3, 96, 100]
    assert one(D.top_up_request(F.lit(200))) == 150


def test_work_items_and_resume(spark):
    variations = spark.createDataFrame([(i, f"v{i}") for i in range(4)], "variation_idx int, variation string")
    items = work.work_items(variations, D.adaptive_chunks(lit("2024-01-01"), lit("2025-12-31")))
    assert items.count() == 100
    assert sorted(r.work_idx for r in items.collect()) == list(range(100))
    done = spark.createDataFrame([(0,), (5,), (99,)], "work_idx int")
    left = {r.work_idx for r in work.unfinished(items, done).collect()}
    assert left == set(range(100)) - {0, 5, 99}
    assert work.from_index(items, 90).count() == 10


@pytest.mark.parametrize("undated", [False, True])
def test_match_posts_equals_nested_loops(spark, undated):
    rng = random.Random(3)
    names = ["aceh banjir", "Medan 2024", "7 di", "#aceh"]
    variations = spark.createDataFrame(list(enumerate(names)), "variation_idx int, variation string")
    items = work.work_items(variations, D.date_chunks(lit("2024-01-01"), lit("2024-01-20")))
    rows = [
        (i, rng.choice(["Banjir di ACEH", "medan ramai", "#Aceh", "lain"]),
         dt.datetime(2023, 12, 30) + dt.timedelta(hours=rng.randrange(600)))
        for i in range(200)
    ]
    posts = spark.createDataFrame(rows, "post_id int, text string, ts timestamp")
    found = {(r.work_idx, r.post_id) for r in work.match_posts(posts, items, undated=undated).collect()}
    words = {0: ["aceh", "banjir"], 1: ["medan"], 2: [], 3: ["#aceh"]}
    wanted = {
        (item.work_idx, i)
        for item in items.collect()
        for i, text, ts in rows
        if item.chunk_start <= ts.date() < item.chunk_end
        and (not words[item.variation_idx] or any(w in text.lower() for w in words[item.variation_idx]))
    }
    assert found == wanted


def test_keep_first_with_one_key_holding_most_rows(spark):
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("url")
    ).repartition(16)
    found = dedup.first_by_url(rows, ["id"])
    assert found.count() == 3001
    assert found.where("url = 'hot'").first().id == 1
    assert sorted(dedup.first_by_url(found, ["id"]).collect()) == sorted(found.collect())


def test_prefix_dedup_keeps_the_first_of_equal_length(spark):
    head = "x" * 50
    rows = spark.createDataFrame(
        [(1, head + "ab"), (2, head + "cd"), (3, head + "abc"), (4, None)], "id int, text string"
    )
    assert sorted(r.id for r in dedup.first_by_prefix(rows, ["id"]).collect()) == [1, 3]


def test_unseen_drops_known_urls_and_blank_ones(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, ""), (5, None)], "id int, url string")
    seen = spark.createDataFrame([("a",), ("a",)], "url string")
    assert [r.id for r in dedup.unseen(new, seen, ["id"]).collect()] == [2]


@pytest.mark.parametrize("count", [0, 7, 1500, 5000])
def test_first_rows_narrow_and_wide(spark, count):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("a"), (-F.col("id")).alias("b"), F.lit("x").alias("text")
    ).repartition(8)
    everything = [tuple(r) for r in rows.orderBy("a", "b").collect()]
    assert [tuple(r) for r in limits.first_rows(rows, ["a", "b"], count).collect()] == everything[:count]


def test_quota_per_group_on_a_hot_group(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 10 > 6).cast("int").alias("g")).repartition(8)
    kept = limits.quota_per_group(rows, "g", ["id"], 40).collect()
    hot = sorted(r.id for r in kept if r.g == 0)
    assert hot == [i for i in range(5000) if i % 10 <= 6][:40]
    assert len(kept) == 80


def test_trailing_counts_match_brute_force(spark):
    rng = random.Random(1)
    base = dt.datetime(2024, 1, 1, 23, 59, 0)
    times = [base + dt.timedelta(microseconds=rng.randrange(150_000_000)) for _ in range(300)]
    times += [base + dt.timedelta(seconds=s) for s in (0, 60, 120)] + [base] * 50
    rows = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    found = {r.ts: r.requests for r in rates.trailing_counts(rows).collect()}
    minute = dt.timedelta(seconds=60)
    assert found == {t: sum(t - minute < u <= t for u in times) for t in set(times)}


def test_running_total_crosses_slices(spark):
    rng = random.Random(2)
    points = {(k, rng.randrange(-500, 500)): rng.randrange(-9, 9) for k in "ab" for _ in range(200)}
    rows = spark.createDataFrame([(k, x, v) for (k, x), v in points.items()], "k string, x bigint, v bigint")
    got = running.running_total(rows, "x", "v", "s", fine=10, coarse=100, keys=["k"]).collect()
    assert len(got) == len(points)
    for row in got:
        assert row.s == sum(v for (k, x), v in points.items() if k == row.k and x <= row.x)


def test_ranking_ties_by_first_appearance(spark):
    posts = spark.createDataFrame([(2, "b a"), (1, "c b"), (3, "a c")], "id bigint, t string")
    terms = ranking.explode_terms(posts.repartition(3), F.split("t", " "), F.col("id"))
    top = ranking.with_rank(ranking.top_terms(ranking.term_counts(terms), 3)).orderBy("rank")
    assert [r.term for r in top.collect()] == ["c", "b", "a"]


def test_expansion_rules(spark):
    text = ["#Banjir #aceh surut di Aceh", "#aceh #Banjir surut macet", "#sekali macet macet 2024 banjirnya"]
    posts = spark.createDataFrame(list(enumerate(text)), "post_id bigint, text string")
    rows = discovery.expand_keywords(posts, "post_id", ["banjir"]).orderBy("variation_idx").collect()
    assert [r.variation for r in rows] == [
        "banjir", "#banjir", "banjir aceh", "banjir macet", "banjir surut", "banjir sekali", "banjir banjirnya", "#aceh",
    ]
    assert len(discovery.expand_keywords(posts, "post_id", ["banjir"], limit=3).collect()) == 3
    one = discovery.smart_query(posts, "post_id", "banjir").first().query
    assert one == "banjir OR #banjir OR #aceh OR #sekali"
    none = discovery.smart_query(posts.limit(0), "post_id", "banjir").first().query
    assert none == "banjir"


def test_fill_from_source_goes_keyword_by_keyword(spark):
    first = spark.createDataFrame([(1, "u1"), (2, "u1")], "id int, url string")

    def source(session, keyword, count):
        return session.range(count).selectExpr("CAST(id AS INT) AS id", f"concat('{keyword}', id % 3) AS url")

    rows = fill.fill_from_source(first, source, ["a", "b"], 5, ["id"]).collect()
    assert [r.url for r in rows] == ["u1", "a0", "a1", "a2", "b0"]
    plain = fill.fill_from_source(first, source, ["a"], 4, ["id"], dedup=False).collect()
    assert [r.url for r in plain] == ["u1", "u1", "a0", "a1"]


def test_stall_runs(spark):
    news = [0, 0, 3, 0, 0, 1, 2, 0]
    loops = spark.createDataFrame([("j", i, n) for i, n in enumerate(news)], "job string, loop int, n int")
    rows = stalls.stall_runs(loops, "job", "loop", "n").orderBy("loop").collect()
    assert [r.stalled for r in rows] == [1, 2, 0, 1, 2, 0, 0, 1]


def test_items_without_readable_dates_match_every_day(spark):
    variations = spark.createDataFrame([(0, "aceh"), (1, "medan")], "variation_idx int, variation string")
    items = work.work_items(variations, D.planned_chunks(F.lit("13/2020"), F.lit("x"), lit("2024-02-01")))
    days = (dt.datetime(2020, 5, 1), dt.datetime(2024, 1, 1))
    posts = spark.createDataFrame([(i, "di Aceh", day) for i, day in enumerate(days)], "post_id int, text string, ts timestamp")
    assert work.match_posts(posts, items).count() == 0
    assert {r.post_id for r in work.match_posts(posts, items, undated=True).collect()} == {0, 1}
