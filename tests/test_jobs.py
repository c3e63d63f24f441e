"""Sentiment, topics, pages, state, stored files, streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidepost.operators import pages, sentiment, state, topics
from tidepost.operators.markup import read_page
from tidepost.plans import jobs
from tidepost.schemas import JOB_UPDATE, POST_JSON
from tidepost.sources import ledger, readers, retention, writers
from tidepost.streaming import operators, timed
from tidepost.streaming.intake import Intake, landed, run_to_table
from tidepost.streaming.progress import Heartbeat

DEMO = [
    ("Pemilu berjalan lancar dan aman", "positive", 1.0),
    ("Korupsi merajalela di pemerintahan", "negative", 1.0),
    ("Cuaca hari ini cerah", "neutral", 0.5),
    ("Kecewa dengan pelayanan yang buruk", "negative", 1.0),
    ("Terima kasih banyak atas bantuannya", "positive", 1.0),
    (None, "neutral", 0.5), ("", "neutral", 0.5), ("  \n", "neutral", 0.5),
    ("bagus tapi buruk", "neutral", 0.5), ("bagus baik buruk", "positive", 0.667),
    ("bagus baik hebat mantap keren sukses senang puas aman | buruk jelek parah gagal marah sedih malu", "positive", 0.562),
]


def test_lexicon_sentiment(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(DEMO)], "i int, text string")
    got = sentiment.with_lexicon_sentiment(rows).orderBy("i").collect()
    assert [(r.sentiment, r.sentiment_score) for r in got] == [(label, s) for _, label, s in DEMO]
    whole = sentiment.with_lexicon_sentiment(
        spark.createDataFrame([("stop itu",)], "text string"), whole_word=True
    ).first()
    assert whole.sentiment == "neutral"


def test_large_lexicon_counts_distinct_terms(spark):
    terms = [f"w{i:03d}" for i in range(300)]
    rows = spark.createDataFrame([("W001 w002 w001",), (None,)], "t string")
    got = rows.select(sentiment.term_hits(F.coalesce("t", F.lit("")), terms).alias("n")).collect()
    assert [r.n for r in got] == [2, 0]


def test_model_failure_marks_only_its_row(spark):
    def load():
        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("bad text")
            return [("POSITIF", 0.98765) for _ in texts]

        return model

    rows = spark.createDataFrame([(0, "fine"), (1, "boom"), (2, " "), (3, None)], "i int, text string")
    got = sentiment.with_model_sentiment(rows.coalesce(1), load).orderBy("i").collect()
    assert [(r.sentiment, r.sentiment_score, r.sentiment_error) for r in got] == [
        ("positive", 0.988, None), ("neutral", 0.5, "bad text"), ("neutral", 0.5, None), ("neutral", 0.5, None),
    ]


def test_frequency_topics_groups(spark):
    text = " ".join(f"kata{i:02d}" for i in range(12))
    rows = spark.createDataFrame([(1, text), (2, None)], "id bigint, text string")
    got = topics.frequency_topics(rows, "id", 3, 5).orderBy("id").collect()
    assert [(len(r.words), r.weight) for r in got] == [(5, 1.0), (5, 1.0), (2, 0.4)]
    few = topics.lda_topics(rows, "id", topics=3, words_per_topic=5)
    assert sorted(few.collect()) == sorted(got)


def test_lda_is_repeatable(spark):
    docs = [(i, f"banjir hujan deras sungai kota{i % 3}" if i % 2 else f"pemilu suara partai debat kota{i % 3}")
            for i in range(60)]
    rows = spark.createDataFrame(docs, "id bigint, text string").coalesce(1)
    first = topics.lda_topics(rows, "id", 2, 4).collect()
    assert first == topics.lda_topics(rows, "id", 2, 4).collect()
    assert [r.id for r in first] == [1, 2]
    known = {w for _, t in docs for w in t.split()}
    assert all(set(r.words) <= known and r.weight > 0 for r in first)


PAGE = """<html><div class="x g"><a href="/1"><h3>One</h3></a><p>Body<br>two</p></div>
<div class="g"><h3></h3><a href="/2">no title</a></div><div class="tF2Cxc"><h3>T</h3></div>
<div data-header-feature><h3>F &amp; G</h3><a href="/4">x</a></div><script>var a='<h3>';</script></html>"""


def test_search_records(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>plain")], "page_id int, html string")
    got = pages.search_records(rows, "page_id").orderBy("pos").collect()
    assert [(r.title, r.body, r.url) for r in got] == [
        ("One", "One\nBody\ntwo", "/1"), ("F & G", "F & G\nx", "/4"),
    ]
    bad = pages.search_records(rows, "page_id", keep_rejected=True)
    assert bad.count() == 2
    row = pages.search_rows(pages.search_records(rows, "page_id"), F.lit(dt.datetime(2026, 1, 2, 3, 4, 5))).first()
    assert (row.source, row.timestamp) == ("google", "2026-01-02 03:04:05")


def test_markup_survives_broken_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 10
    assert read_page(deep).text() == "x"
    assert read_page("</p><b>a</i>b").text() == "ab"
    assert [e.attrs.get("id") for e in read_page("<ul id=a><li id=b><img id=c></ul>").find_all("ul li")] == ["b"]


def test_page_outcomes(spark):
    rows = spark.createDataFrame(
        [("https://x/login", ""), ("https://x/home", ""), ("https://x/search?home", "<article>"),
         ("https://x/search", "No results for z"), ("https://x/search", "")], "url string, html string")
    got = rows.select(pages.page_outcome(F.col("url"), F.col("html"), "<article").alias("o")).collect()
    assert [r.o for r in got] == ["login", "home", "results", "no_results", "unknown"]


def update(seq, **given):
    row = dict.fromkeys(JOB_UPDATE.fieldNames()) | {"seq": seq, "id": "j"} | given
    return tuple(row[name] for name in JOB_UPDATE.fieldNames())


def test_latest_jobs_rules(spark):
    day = dt.datetime(2026, 1, 1)
    added = dict(keyword="k", target_count=5, status="RUNNING", progress="Starting...", created_at=day, worker_mode=3)
    rows = [
        update(1, **added), update(2, status="RUNNING", progress="half"), update(3, status="COMPLETED", progress="", result_file="f.csv"),
        update(4, id="gone", **added), update(5, id="gone", removed=True), update(6, id="gone", status="FAILED"),
        update(7, id="back", **added), update(8, id="back", removed=True), update(9, id="back", **(added | {"keyword": "new"})),
        update(10, id="stop", **added), update(11, id="stop", status="CANCELLING", cancel_requested=True),
        update(12, id="never added", status="FAILED"),
    ]
    jobs_now = {r.id: r for r in state.latest_jobs(spark.createDataFrame(rows, JOB_UPDATE)).collect()}
    assert set(jobs_now) == {"j", "back", "stop"}
    assert (jobs_now["j"].status, jobs_now["j"].progress, jobs_now["j"].result_file) == ("COMPLETED", "half", "f.csv")
    assert jobs_now["back"].keyword == "new"
    assert jobs_now["stop"].cancel_requested


def test_completed_batches_only(spark):
    rows = spark.createDataFrame(
        [("a", True, "1"), ("a", True, None), ("b", True, "2"), ("b", False, "3")], "batch_id string, done boolean, result_file string")
    assert [tuple(r) for r in state.completed_batch_files(rows).collect()] == [("a", "1")]


# --- stored files ------------------------------------------------------------------

POST = {
    "username": "u", "text": 'two\nlines, "quoted"', "text_clean": "x", "hashtags": ["#a"],
    "timestamp": "2026-01-20T13:40:43.000Z", "url": "https://p.example/1", "replies": 1, "retweets": 2, "likes": 3,
    "scraped_at": "2026-01-20T13:40:43.533319",
}


def test_read_posts_by_suffix(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([POST, POST | {"likes": None}]))
    rows = spark.createDataFrame([POST], POST_JSON)
    writers.write_csv_sorted(rows, str(tmp_path / "b.csv"))
    writers.write_json_and_csv(rows, str(tmp_path / "c.jsonl"), str(tmp_path / "c.csv"))
    paths = [str(tmp_path / n) for n in ("a.json", "b.csv", "c.jsonl", "c.csv", "missing.csv", "d.xlsx")]
    got = readers.read_posts(spark, paths).collect()
    assert len(got) == 5
    assert {r.text for r in got} == {POST["text"]}
    assert {tuple(r.hashtags) for r in got} == {("#a",)}
    assert sorted(r.likes for r in got) == [0, 3, 3, 3, 3]
    assert {r.timestamp for r in got} == {dt.datetime(2026, 1, 20, 13, 40, 43)}
    assert readers.read_posts(spark, ["/nowhere.csv"]).count() == 0


def test_score_and_topics_of_stored_table(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([POST | {"text": t, "url": str(i)} for i, (t, _, _) in enumerate(DEMO)]))
    scored = jobs.score_table(spark, str(tmp_path / "a.json"), str(tmp_path / "out.csv"))
    assert scored.count() == len(DEMO)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out.csv"))
    assert back.where("sentiment = 'positive'").count() == 4
    assert jobs.topics_of_table(spark, str(tmp_path / "a.json"), "url", topics=2, words_per_topic=3).count() == 2


def test_checkpoint_summary(spark, tmp_path):
    (tmp_path / "full.json").write_text(json.dumps({
        "base_keyword": "k", "current_chunk_idx": 4, "total_chunks": 54, "all_tweets": [POST], "saved_at": "s", "worker_mode": 5}, indent=2))
    (tmp_path / "bare.json").write_text("{}")
    (tmp_path / "broken.json").write_text("{ nope")
    rows = {r.job_id: r for r in state.checkpoint_summary(readers.read_checkpoints(spark, str(tmp_path))).collect()}
    assert set(rows) == {"full", "bare"}
    assert tuple(rows["full"])[1:] == ("k", "4/54", 1, "s", 5)
    assert tuple(rows["bare"])[1:] == ("Unknown", "0/?", 0, "Unknown", 3)


def test_ledger_resume_fills_gaps(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    assert not book.exists("j")
    rows = spark.createDataFrame([(0, 5, 2), (3, 1, 1)], "work_idx bigint, fetched bigint, new_unique bigint")
    book.save("j", rows)
    book.save("j", rows.limit(1))
    assert sorted(r.work_idx for r in book.load("j").collect()) == [0, 3]
    assert book.highest("j").first().highest == 3
    book.delete("j")
    assert not book.exists("j")
    book.save("j", rows.limit(1))
    assert book.exists("j")


def test_retention(spark, tmp_path):
    asof = dt.datetime(2026, 1, 10)
    rows = spark.createDataFrame([(asof - dt.timedelta(days=d),) for d in (0, 3, 4)], "ts timestamp")
    assert retention.retained(rows, "ts", F.lit(asof)).count() == 2
    (tmp_path / "old.html").write_text("<p>x")
    assert retention.expired_files(spark, str(tmp_path), F.current_timestamp() + F.expr("INTERVAL 4 DAYS")).count() == 1
    assert retention.expired_files(spark, str(tmp_path), F.current_timestamp()).count() == 0
    assert readers.read_pages(spark, str(tmp_path)).first().html == "<p>x"


# --- streams -------------------------------------------------------------------------

SCHEMA = "post_id bigint, url string, text string, at timestamp"


def land(spark, folder, parts):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def post(i, url=None, text=None):
    return (i, url or f"u{i}", text or f"text {i}", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i))


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_intake_dedups_across_batches_and_resumes(spark, tmp_path, schema):
    land(spark, tmp_path / "in", [[post(1), post(2, "u1")], [post(3, "u1"), post(4)]])
    intake = Intake(spark, str(tmp_path / "sink"), str(tmp_path / "state"), schema, ["post_id"])
    stream = landed(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    assert {r.url for r in intake.run(stream).collect()} == {"u1", "u4"}
    land(spark, tmp_path / "in", [[post(5, "u4"), post(6)]])
    assert {r.url for r in intake.run(stream).collect()} == {"u1", "u4", "u6"}
    intake._take(spark.createDataFrame([post(6)], schema), 2)  # a batch Spark repeats
    assert intake.rows().count() == 3


def test_intake_stops_at_target(spark, tmp_path, schema):
    land(spark, tmp_path / "in", [[post(i) for i in range(n, n + 5)] for n in range(0, 30, 5)])
    intake = Intake(spark, str(tmp_path / "sink"), str(tmp_path / "state"), schema, ["post_id"], target=7)
    rows = intake.run(landed(spark, str(tmp_path / "in"), schema, files_per_trigger=1))
    assert rows.count() == 7
    assert intake._stored().count() >= 7
    intake.target = None
    stream = landed(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    assert intake.run(stream).count() == 30  # the next run loses nothing


def test_intake_time_limit_raises(spark, tmp_path, schema):
    land(spark, tmp_path / "in", [[post(i)] for i in range(40)])
    intake = Intake(spark, str(tmp_path / "sink"), str(tmp_path / "state"), schema, ["post_id"])
    with pytest.raises(TimeoutError):
        intake.run(landed(spark, str(tmp_path / "in"), schema, files_per_trigger=1), timeout=1)
    assert intake.run(landed(spark, str(tmp_path / "in"), schema)).count() == 40


def test_unreadable_json_is_left_out_and_listed(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"username": "a", "text": "x", "url": "u1"}]')
    (tmp_path / "bad.json").write_text("{not json at all")
    paths = [str(tmp_path / "good.json"), str(tmp_path / "bad.json")]
    assert [r.url for r in readers.read_json_posts(spark, paths).collect()] == ["u1"]
    assert [r.file.rsplit("/", 1)[-1] for r in readers.unreadable_json(spark, paths).collect()] == ["bad.json"]
    assert readers.stored_count(spark, paths[0]) == 1


def test_lexicons_of_any_size_count_distinct_terms(spark):
    rows = spark.createDataFrame([("good good bad",)], "text string")
    for extra in (0, 199, 400):
        terms = ["good", "GOOD", "", *[f"t{i}x" for i in range(extra)]]
        assert rows.select(sentiment.term_hits(rows.text, terms).alias("n")).first().n == 1


def test_near_copies_in_different_chunks_stay(spark):
    text = "a long enough text about banjir in the city"
    rows = [
        (1, "a", text, "u1", dt.datetime(2024, 1, 2), "en", False),
        (2, "b", text, "u2", dt.datetime(2024, 1, 12), "en", False),
        (3, "c", text, "u3", dt.datetime(2024, 1, 13), "en", False),
    ]
    posts = spark.createDataFrame(
        rows, "post_id int, username string, text string, url string, ts timestamp, lang string, is_reply boolean"
    )
    found = jobs.standard_job(posts, ["banjir"], "2024-01-01", "2024-02-01", 100)
    assert sorted(r.post_id for r in found.collect()) == [1, 2]
    for start, end in (("2024-1-1", "2024-1-31"), ("13/2020", "x")):
        ran = jobs.expand_job(posts, ["banjir"], start, end, asof="2024-02-01", count=10)
        assert ran.count() >= 1


def test_stream_dedup_over_batches(spark, tmp_path, schema):
    land(spark, tmp_path / "in", [[post(i, text="same") for i in range(3)], [post(9, text="same"), post(10, text="other")]])
    stream = landed(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    unique = operators.first_by_prefix(stream, "at", "1 day", spread="post_id")
    rows = run_to_table(unique, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.text for r in rows.collect()) == ["other", "same"]


def test_stalls_carry_state_over_runs(spark, tmp_path, schema):
    found = []
    for part in ([post(0, "a"), post(1, "a"), post(2, "b")], [post(5, "a")], [post(9, "a"), post(60, "b")]):
        land(spark, tmp_path / "in", [part])
        counts = operators.loop_counts(landed(spark, str(tmp_path / "in"), schema), "url", "at", 60)
        with timed.timers(spark):
            rows = run_to_table(timed.silences(counts, 60), str(tmp_path / "out"), str(tmp_path / "state"))
        found = rows.where("job = 'a' AND new_rows > 0").orderBy("loop").collect()
    assert [r.stalled for r in found] == [0, 0, 3, 3]


def test_heartbeat_reports_progress(spark, tmp_path, schema):
    land(spark, tmp_path / "in", [[post(i) for i in range(4)]])
    lines = []
    beat = Heartbeat(emit=lines.append, seconds=0)
    spark.streams.addListener(beat)
    try:
        stream = landed(spark, str(tmp_path / "in"), schema)
        run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        import time

        for _ in range(50):
            if beat.latest:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(beat)
    assert sum(p["total_rows"] for p in beat.latest.values()) == 4
    assert lines
