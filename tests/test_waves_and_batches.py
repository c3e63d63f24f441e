"""Waves with quotas, merged batches, smart mode, stalls by slices: against plain loops."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidepost.operators import stalls
from tidepost.plans import jobs, waves


def plain_waves(rows, items, target, workers, least):
    """(work_idx, order, url) the way a job that asks item after item collects them."""
    seen, out = set(), []
    for first in range(0, items, workers):
        if len(seen) >= target:
            break
        quota = max(least, math.ceil((target - len(seen)) / (items - first)))
        asked = []
        for item in range(first, min(items, first + workers)):
            asked += sorted((w, o, u) for w, o, u in rows if w == item)[:quota]
        fresh = {}
        for w, o, u in sorted(asked, key=lambda r: r[:2]):
            if u and u not in seen:
                fresh.setdefault(u, (w, o, u))
        seen |= set(fresh)
        out += fresh.values()
    return sorted(out)


@pytest.mark.parametrize("workers,least,target", [(1, 1, 30), (3, 2, 25), (4, 50, 10), (50, 1, 1000)])
def test_waves_by_plain_loops_and_resumed(spark, tmp_path, workers, least, target):
    rng = random.Random(workers)
    rows = [(rng.randrange(12), i, rng.choice([None, "", *[f"u{k}" for k in range(40)]])) for i in range(200)]
    table = spark.createDataFrame(rows, "work_idx long, ord long, url string")
    wanted = plain_waves(rows, 12, target, workers, least)
    whole = waves.run_waves(table, 12, target, f"{tmp_path}/whole", ["ord"], workers, least)
    assert sorted((r.work_idx, r.ord, r.url) for r in whole.collect()) == wanted
    for _ in range(13):  # one wave a run
        parts = waves.run_waves(table, 12, target, f"{tmp_path}/parts", ["ord"], workers, least, most_waves=1)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_no_waves(spark, tmp_path):
    table = spark.createDataFrame([], "work_idx long, ord long, url string")
    assert waves.run_waves(table, 0, 10, f"{tmp_path}/a", ["ord"]).columns == ["work_idx", "ord", "url", "wave"]
    assert waves.run_waves(table, 5, 10, f"{tmp_path}/b", ["ord"]).count() == 0
    assert waves.wave_quota(10, 10, 3) == 0 and waves.wave_quota(1000, 0, 3) == 334


def test_merged_batches(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,url\n"two\nlines",u1\nplain,u2\n')
    (tmp_path / "b.json").write_text(json.dumps([{"url": "u3", "text": "from json", "other": [1]}]))
    (tmp_path / "c.json").write_text("{no json")
    rows = [("x", True, "a.csv"), ("x", True, "b.json"), ("x", True, "none.csv"), ("x", True, None), ("y", True, "a.csv"), ("y", False, None), ("z", True, "c.json"), (None, True, "a.csv")]
    listed = spark.createDataFrame([(b, d, f and str(tmp_path / f)) for b, d, f in rows], "batch_id string, done boolean, result_file string")
    for _ in range(2):  # the second call finds the batches merged
        merged = jobs.merge_finished_batches(spark, listed, f"{tmp_path}/out").collect()
        assert [(r.batch_id, r.files, r.rows) for r in merged] == [("x", 2, 3)]
    text = spark.read.option("header", True).option("multiLine", True).csv(merged[0].merged_file)
    assert text.columns == ["text", "url"] and {tuple(r) for r in text.collect()} == {("two\nlines", "u1"), ("plain", "u2"), ("from json", "u3")}
    assert jobs.merge_finished_batches(spark, listed.where("false"), f"{tmp_path}/out").count() == 0


def test_smart_mode_searches_the_tags_of_a_sample(spark):
    start = dt.datetime(2024, 1, 1)
    texts = ["banjir di kota kami #Aceh #bantu", "banjir lagi pagi ini #aceh", "kabar dari #aceh hari ini saja", "tanpa kata dan tanpa tagar", "hanya #bantu saja yang ada", "banjir #lain jauh sekali sana"]
    rows = [(i, t, f"u{i}", start, "id", False) for i, t in enumerate(texts)]
    posts = spark.createDataFrame(rows, "post_id long, text string, url string, ts timestamp_ntz, lang string, is_reply boolean")
    assert jobs.related_tags(posts, ["banjir"], 2) == ["#aceh", "#bantu"]
    assert jobs.related_tags(posts, ["banjir"], 2, tags=1) == ["#aceh"]
    found = jobs.standard_job(posts, ["banjir"], None, None, None, smart=2)
    assert sorted(r.post_id for r in found.collect()) == [0, 1, 2, 4, 5]
    assert sorted(r.post_id for r in jobs.standard_job(posts, ["nichts"], None, None, None, smart=2).collect()) == []


def test_stalls_by_slices(spark):
    rng = random.Random(0)
    rows = [(job, i * 3, rng.choice([0, 0, 0, 0, 0, 0, 0, None, 2])) for job in ("a", None, "b") for i in range(300)]
    rows += [("quiet", i, 0) for i in range(50)]
    wanted = {}
    for job in ("a", None, "b", "quiet"):
        n = 0
        for _, loop, new in sorted((r for r in rows if r[0] == job), key=lambda r: r[1]):
            n = 0 if new else n + 1
            wanted[job, loop] = n
    table = spark.createDataFrame(rows, "job string, loop long, new_rows long")
    for width in (1, 7, 10_000):
        found = stalls.stall_runs(table, "job", "loop", "new_rows", F.floor(F.col("loop") / width))
        assert {(r.job, r.loop): r.stalled for r in found.collect()} == wanted
        assert found.columns == [*table.columns, "stalled"]
    assert stalls.stall_runs(table.where("false"), "job", "loop", "new_rows").count() == 0
