"""Queries over job state, batches, logs, checkpoints, stored files and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepost.catalog.registry import POSTS, posts, register, table
from tidepost.operators import limits, pages, stalls, state
from tidepost.plans import fill
from tidepost.session import scratch_path
from tidepost.sources import readers, retention, writers

# --- job updates drawn from events ------------------------------------------------

UPDATES = """updates AS (SELECT event_id AS seq, 'job-' || user_id AS id,
    CASE WHEN event_type = 'signup' THEN 'Kw ' || (user_id % 20) END AS keyword,
    CASE WHEN event_type = 'signup' THEN user_id * 10 END AS target_count,
    CASE event_type WHEN 'signup' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED'
      WHEN 'error' THEN (CASE WHEN event_id % 7 = 0 THEN 'CANCELLING' ELSE 'FAILED' END)
      ELSE 'PENDING' END AS status,
    CASE event_type WHEN 'signup' THEN 'Starting...' WHEN 'click' THEN 'row ' || event_id WHEN 'view' THEN '' END AS progress,
    CASE WHEN event_type = 'purchase' THEN 'f' || event_id || '.csv' END AS result_file,
    CASE WHEN event_type = 'signup' THEN ts END AS created_at,
    CASE WHEN event_type = 'signup' THEN CAST(user_id % 3 * 2 + 1 AS INTEGER) END AS worker_mode,
    event_type = 'error' AND event_id % 7 = 0 AS cancel_requested,
    event_type = 'view' AND event_id % 40 = 0 AS removed FROM events),
    live AS (SELECT id, max(seq) FILTER (created_at IS NOT NULL) AS start, max(seq) FILTER (removed) AS gone
      FROM updates GROUP BY id HAVING start IS NOT NULL AND (gone IS NULL OR start > gone)),
    jobs AS (SELECT id, max(keyword) FILTER (seq = start) AS keyword, max(target_count) FILTER (seq = start) AS target_count,
      arg_max(status, seq) AS status, arg_max(progress, seq) FILTER (coalesce(progress, '') <> '') AS progress,
      arg_max(result_file, seq) FILTER (coalesce(result_file, '') <> '') AS result_file,
      max(created_at) FILTER (seq = start) AS created_at, max(worker_mode) FILTER (seq = start) AS worker_mode,
      bool_or(coalesce(cancel_requested, FALSE)) AS cancel_requested
      FROM updates JOIN live USING (id) WHERE seq >= start GROUP BY id)"""


def _updates(spark, folder):
    kind, seq, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    added = kind == "signup"
    cancel = (kind == "error") & (seq % 7 == 0)
    return table(spark, folder, "events").select(
        seq.alias("seq"),
        F.concat(F.lit("job-"), user.cast("string")).alias("id"),
        F.when(added, F.concat(F.lit("Kw "), (user % 20).cast("string"))).alias("keyword"),
        F.when(added, user * 10).alias("target_count"),
        F.when(kind.isin("signup", "click"), "RUNNING")
        .when(kind == "purchase", "COMPLETED")
        .when(cancel, "CANCELLING")
        .when(kind == "error", "FAILED")
        .otherwise("PENDING")
        .alias("status"),
        F.when(added, "Starting...")
        .when(kind == "click", F.concat(F.lit("row "), seq.cast("string")))
        .when(kind == "view", "")
        .alias("progress"),
        F.when(kind == "purchase", F.concat(F.lit("f"), seq.cast("string"), F.lit(".csv"))).alias(
            "result_file"
        ),
        F.when(added, F.col("ts")).alias("created_at"),
        F.when(added, (user % 3 * 2 + 1).cast("int")).alias("worker_mode"),
        cancel.alias("cancel_requested"),
        ((kind == "view") & (seq % 40 == 0)).alias("removed"),
    )


@register("job_latest", f"WITH {UPDATES} SELECT * FROM jobs")
def job_latest(spark, folder):
    return state.latest_jobs(_updates(spark, folder))


@register(
    "recent_jobs",
    f"WITH {UPDATES} SELECT id, created_at, status FROM jobs ORDER BY created_at DESC, id LIMIT 10",
)
def recent_jobs(spark, folder):
    jobs = state.latest_jobs(_updates(spark, folder))
    return state.recent_jobs(jobs).select("id", "created_at", "status")


@register("cancelled_jobs", f"WITH {UPDATES} SELECT id, status FROM jobs WHERE cancel_requested")
def cancelled_jobs(spark, folder):
    return state.cancelled(state.latest_jobs(_updates(spark, folder))).select("id", "status")


@register(
    "active_duplicates",
    f"""WITH {UPDATES} SELECT c_custkey FROM customer WHERE 'kw ' || (c_custkey % 25) IN
    (SELECT lower(keyword) FROM jobs WHERE status IN ('RUNNING', 'PENDING'))""",
)
def active_duplicates(spark, folder):
    jobs = state.latest_jobs(_updates(spark, folder)).withColumn(
        "keyword", F.concat(F.lit(">> "), "keyword", F.lit(" (Expand)"))
    )
    requests = table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("KW "), (F.col("c_custkey") % 25).cast("string")).alias("keyword")
    )
    return state.active_duplicates(requests, jobs, (">> ", " (Expand)")).select("c_custkey")


@register(
    "batch_files",
    """SELECT l_orderkey AS batch_id, 'part-' || l_partkey || '.csv' AS result_file FROM lineitem
    WHERE l_linenumber <> 2 AND l_orderkey IN
      (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'O'))""",
)
def batch_files(spark, folder):
    name = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"), F.lit(".csv"))
    jobs = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        (F.col("l_linestatus") == "O").alias("done"),
        F.when(F.col("l_linenumber") != 2, name).alias("result_file"),
    )
    return state.completed_batch_files(jobs)


@register(
    "log_tail",
    """SELECT event_id, ts, event_type AS level, props AS message FROM
    (SELECT * FROM events ORDER BY event_id DESC LIMIT 50)""",
)
def log_tail(spark, folder):
    logs = table(spark, folder, "events").select(
        "event_id", "ts", F.col("event_type").alias("level"), F.col("props").alias("message")
    )
    return state.log_tail(logs, "event_id")


@register(
    "checkpoint_summary",
    """SELECT 'job-' || doc_id AS job_id, CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE source END AS keyword,
      (CASE WHEN doc_id % 7 = 0 THEN '0' ELSE CAST(n_chars % 50 AS VARCHAR) END) || '/'
        || (CASE WHEN doc_id % 3 = 0 THEN '?' ELSE CAST(n_chars AS VARCHAR) END) AS progress,
      CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS tweets_collected,
      CASE WHEN doc_id % 2 = 0 THEN 'Unknown' ELSE '2026-01-01T00:00:00' END AS saved_at,
      CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 5 END AS worker_mode FROM documents""",
)
def checkpoint_summary(spark, folder):
    i, n = F.col("doc_id"), F.col("n_chars")
    stored = table(spark, folder, "documents").select(
        F.concat(F.lit("checkpoints/job-"), i.cast("string"), F.lit(".json")).alias("file"),
        F.when(i % 5 != 0, F.col("source")).alias("base_keyword"),
        F.when(i % 7 != 0, n % 50).alias("current_chunk_idx"),
        F.when(i % 3 != 0, n).alias("total_chunks"),
        F.when(i % 11 != 0, F.split("text", "\n")).alias("all_tweets"),
        F.when(i % 2 != 0, "2026-01-01T00:00:00").alias("saved_at"),
        F.when(i % 4 != 0, 5).alias("worker_mode"),
    )
    return state.checkpoint_summary(stored)


@register(
    "retention",
    "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY",
)
def retention_query(spark, folder):
    events = table(spark, folder, "events")
    newest = events.agg(F.max("ts")).scalar()
    return retention.retained(events, "ts", newest).select("event_id")


@register(
    "preview",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def preview(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return limits.first_rows(rows, [F.desc("o_totalprice"), "o_orderkey"], 10)


@register(
    "stall_runs",
    """WITH loops AS (SELECT user_id, date_trunc('hour', ts) AS loop,
        CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS new_rows FROM events GROUP BY 1, 2),
    marked AS (SELECT *, count(*) FILTER (new_rows > 0) OVER (PARTITION BY user_id ORDER BY loop) AS island FROM loops)
    SELECT user_id, loop, new_rows, CAST(CASE WHEN new_rows > 0 THEN 0 WHEN island = 0
      THEN row_number() OVER (PARTITION BY user_id, island ORDER BY loop)
      ELSE row_number() OVER (PARTITION BY user_id, island ORDER BY loop) - 1 END AS INTEGER) AS stalled FROM marked""",
)
def stall_runs(spark, folder):
    loops = (
        table(spark, folder, "events")
        .groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("loop"))
        .agg(F.count_if(F.col("event_type") == "signup").alias("new_rows"))
    )
    return stalls.stall_runs(loops, "user_id", "loop", "new_rows")


# --- sources, unions, stored files ---------------------------------------------------

def _search_rows(spark, folder):
    """Second source: link records of the saved pages, as search rows plus an order key."""
    records = pages.search_records(
        table(spark, folder, "pages"), "page_id", containers=("li",), title="a", link="a"
    )
    return records.select(
        (F.col("page_id") * 1000 + F.col("pos")).alias("post_id"),
        F.concat_ws("\n", "title", "body").alias("text"),
        "url",
        F.lit("google").alias("source"),
    )


SEARCH_ORDERED = """search AS (SELECT page_id * 1000 + pos AS post_id, title || chr(10) || title AS text, url, 'google' AS source FROM (
      SELECT page_id, unnest(h) AS url, unnest(t) AS title, unnest(range(len(h))) AS pos FROM (
      SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h,
             regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS t FROM pages)))"""


@register(
    "fallback_fill",
    f"""WITH {POSTS}, {SEARCH_ORDERED},
    both_ AS (SELECT 0 AS s, post_id, url, text, source FROM posts UNION ALL SELECT 1, post_id, url, text, source FROM search),
    firsts AS (SELECT * FROM both_ WHERE coalesce(url, '') <> ''
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY s, post_id) = 1)
    SELECT post_id, url, text, source FROM firsts ORDER BY s, post_id LIMIT 6000""",
)
def fallback_fill(spark, folder):
    first = posts(spark, folder).select("post_id", "url", "text", "source")
    return fill.fill_to_target([first, _search_rows(spark, folder)], 6000, ["post_id"])


@register(
    "fallback_fill_plain",
    f"""WITH {POSTS}, {SEARCH_ORDERED},
    both_ AS (SELECT 0 AS s, post_id, url, source FROM posts UNION ALL SELECT 1, post_id, url, source FROM search)
    SELECT post_id, url, source FROM both_ ORDER BY s, post_id LIMIT 1500""",
)
def fallback_fill_plain(spark, folder):
    first = posts(spark, folder).select("post_id", "url", "source")
    second = _search_rows(spark, folder).drop("text")
    return fill.fill_to_target([first, second], 1500, ["post_id"], dedup=False)


@register(
    "fallback_fill_uncapped",
    f"""WITH {POSTS}, {SEARCH_ORDERED},
    both_ AS (SELECT 0 AS s, post_id, url, text, source FROM posts UNION ALL SELECT 1, post_id, url, text, source FROM search)
    SELECT post_id, url, text, source FROM both_ WHERE coalesce(url, '') <> ''
      QUALIFY row_number() OVER (PARTITION BY url ORDER BY s, post_id) = 1""",
)
def fallback_fill_uncapped(spark, folder):
    first = posts(spark, folder).select("post_id", "url", "text", "source")
    return fill.fill_to_target([first, _search_rows(spark, folder)], None, ["post_id"])


@register(
    "fallback_fill_plain_uncapped",
    f"""WITH {POSTS}, {SEARCH_ORDERED}
    SELECT post_id, url, source FROM posts UNION ALL SELECT post_id, url, source FROM search""",
)
def fallback_fill_plain_uncapped(spark, folder):
    first = posts(spark, folder).select("post_id", "url", "source")
    second = _search_rows(spark, folder).drop("text")
    return fill.fill_to_target([first, second], None, ["post_id"], dedup=False)


@register(
    "missing_rows",
    f"""WITH {POSTS}, firsts AS (SELECT DISTINCT url FROM posts WHERE url IS NOT NULL)
    SELECT count(*) AS total, CAST(greatest(0, 1000000 - count(*)) AS BIGINT) AS missing,
      CAST(least(greatest(0, 1000000 - count(*)) + 20, 150) AS BIGINT) AS ask FROM firsts""",
)
def missing_rows(spark, folder):
    urls = posts(spark, folder).where("url IS NOT NULL").select("url").distinct()
    return fill.missing_rows(urls, 1000000)


@register(
    "mixed_union",
    f"""WITH {POSTS}, {SEARCH_ORDERED} SELECT is_reply, lang, post_id, source, text, url, username FROM
    (SELECT post_id, username, text, url, lang, source, is_reply FROM posts
     UNION ALL BY NAME SELECT post_id, text, url, source FROM search)""",
)
def mixed_union(spark, folder):
    first = posts(spark, folder).select(
        "post_id", "username", "text", "url", "lang", "source", "is_reply"
    )
    return fill.mixed_union([first, _search_rows(spark, folder)])


@register(
    "batch_merge",
    f"""WITH {POSTS}, {SEARCH_ORDERED}
    SELECT post_id, url, lang FROM posts WHERE lang <> 'en'
    UNION ALL SELECT post_id, url, lang FROM posts WHERE lang = 'en'
    UNION ALL SELECT post_id, url, NULL FROM search""",
)
def batch_merge(spark, folder):
    rows = posts(spark, folder).select("post_id", "url", "lang")
    chunks = fill.concat_rows([rows.where("lang <> 'en'"), rows.where("lang = 'en'")])
    return fill.merge_first_schema([chunks, _search_rows(spark, folder)])


STORED = f"""WITH {POSTS} SELECT username, text, array_to_string(regexp_extract_all(text, '#[\\p{{L}}\\p{{N}}_]+'), ' ') AS hashtags,
    url, n_chars AS likes, CAST(0 AS BIGINT) AS replies, ts AS timestamp FROM posts"""


def _storable(spark, folder):
    from tidepost.functions.text import hashtags

    rows = posts(spark, folder)
    return rows.select(
        "username",
        "text",
        F.lit(None).cast("string").alias("text_clean"),
        hashtags(F.col("text")).alias("hashtags"),
        F.col("ts").cast("string").alias("timestamp"),
        "url",
        F.lit(None).cast("bigint").alias("replies"),
        F.lit(None).cast("bigint").alias("retweets"),
        F.col("n_chars").alias("likes"),
        F.lit(None).cast("string").alias("scraped_at"),
    )


def _read_back(spark, path):
    return readers.read_posts(spark, [path]).select(
        "username",
        "text",
        F.array_join("hashtags", " ").alias("hashtags"),
        "url",
        "likes",
        "replies",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
    )


@register("csv_store", STORED)
def csv_store(spark, folder):
    path = scratch_path(spark, "posts") + ".csv"
    writers.write_csv(_storable(spark, folder), path)
    return _read_back(spark, path)


@register("json_store", STORED)
def json_store(spark, folder):
    path = scratch_path(spark, "posts") + ".jsonl"
    writers.write_json(_storable(spark, folder), path)
    return _read_back(spark, path)


@register("sorted_csv_store", STORED)
def sorted_csv_store(spark, folder):
    path = scratch_path(spark, "sorted") + ".csv"
    writers.write_csv_sorted(_storable(spark, folder), path)
    return _read_back(spark, path)


@register("json_and_csv_store", STORED)
def json_and_csv_store(spark, folder):
    path = scratch_path(spark, "both")
    writers.write_json_and_csv(_storable(spark, folder), path + ".jsonl", path + ".csv")
    return _read_back(spark, path + ".csv")


@register("stored_count", "SELECT lang, count(*) AS rows FROM documents GROUP BY lang")
def stored_count(spark, folder):
    """Rows of a stored result, counted by one of its columns."""
    path = scratch_path(spark, "counted") + ".parquet"
    table(spark, folder, "documents").select("text", "lang").write.parquet(path)
    return readers.read_posts(spark, [path]).groupBy("lang").agg(F.count("*").alias("rows"))
