"""Streaming forms, run over the landed table files until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepost.catalog.posts import FIRST_BY_URL
from tidepost.catalog.registry import POSTS, as_posts, posts, register, table
from tidepost.session import scratch_path
from tidepost.streaming.intake import Intake, landed, run_to_table
from tidepost.streaming import operators, timed


def _stream(spark, folder, name):
    schema = table(spark, folder, name).schema
    # a pattern, as Spark streams from a file or from a folder of files only by a pattern alike
    return landed(spark, f"{folder}/{name}.parque[t]", schema)


def _run(spark, stream, name):
    return run_to_table(stream, scratch_path(spark, name), scratch_path(spark, name + "-state"))


@register(
    "stream_dedup",
    "SELECT DISTINCT text[1:50] AS prefix, CAST(length(text) AS INTEGER) AS size FROM documents WHERE text IS NOT NULL",
)
def stream_dedup(spark, folder):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    rows = _stream(spark, folder, "documents").select("doc_id", "text", at.alias("at"))
    unique = operators.first_by_prefix(rows, "at", "36500 days", spread="doc_id")
    return _run(spark, unique, "dedup").select("prefix", "size")


@register(
    "stream_rate",
    """WITH w AS (SELECT time_bucket(INTERVAL 5 SECOND, ts, TIMESTAMP '1970-01-01') - to_seconds(5 * k) AS window_start
        FROM events, range(12) AS r(k)),
    n AS (SELECT window_start, count(*) AS requests FROM w GROUP BY 1)
    SELECT window_start, requests, CASE WHEN requests >= 3 THEN 'HOT' WHEN requests >= 2 THEN 'WARM' ELSE 'COOL' END AS status,
      CAST(least(100, floor(requests / 4 * 100)) AS INTEGER) AS percent
    FROM n WHERE window_start + INTERVAL 60 SECOND <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
)
def stream_rate(spark, folder):
    events = _stream(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    rated = operators.rolling_rate(events, limit=4, warning=2, danger=3)
    return _run(spark, rated, "rate").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests", "status", "percent"
    )


@register(
    "stream_stalls",
    """WITH loops AS (SELECT event_type AS job, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS loop, count(*) AS new_rows
        FROM events GROUP BY 1, 2)
    SELECT job, loop, new_rows, CAST(coalesce((loop - lag(loop) OVER (PARTITION BY job ORDER BY loop)) // 3600 - 1, 0) AS BIGINT) AS stalled
    FROM loops QUALIFY loop + 3600 <= (SELECT epoch(max(ts)) FROM events)""",
)
def stream_stalls(spark, folder):
    return _silences(spark, folder).where("new_rows > 0")


# loops without a row after which a job counts as ended
GIVE_UP = 15


def _silences(spark, folder):
    events = _stream(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    counts = operators.loop_counts(events, "event_type", "ts", 3600)
    with timed.timers(spark):
        return _run(spark, timed.silences(counts, 3600, GIVE_UP), "stalls")


@register(
    "stream_silences",
    f"""WITH busy AS (SELECT event_type AS job, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS loop, count(*) AS new_rows
        FROM events GROUP BY 1, 2 HAVING loop + 3600 <= (SELECT epoch(max(ts)) FROM events)),
    next AS (SELECT *, lead(loop) OVER (PARTITION BY job ORDER BY loop) AS after, lag(loop) OVER (PARTITION BY job ORDER BY loop) AS before FROM busy),
    quiet AS (SELECT job, loop, after, unnest(range(1, {GIVE_UP + 1})) AS stalled FROM next)
    SELECT job, loop, new_rows, CAST(coalesce((loop - before) // 3600 - 1, 0) AS BIGINT) AS stalled FROM next
    UNION ALL SELECT job, loop + stalled * 3600, 0, stalled FROM quiet
    WHERE (after IS NULL AND loop + (stalled + 1) * 3600 <= (SELECT epoch(max(ts)) FROM events)) OR loop + stalled * 3600 < after""",
)
def stream_silences(spark, folder):
    return _silences(spark, folder)


@register(
    "stream_first_copies",
    """SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id // 48 < (SELECT max(doc_id) // 48 FROM documents)
    QUALIFY row_number() OVER (PARTITION BY doc_id // 48, text[1:50], length(text) ORDER BY doc_id) = 1""",
)
def stream_first_copies(spark, folder):
    """Slices of two days; the last one is still open when the stream has been read."""
    at = F.timestamp_seconds(F.lit(0) + F.col("doc_id") * 3600)
    rows = _stream(spark, folder, "documents").select("doc_id", "text", at.alias("at"))
    first = operators.first_copies(rows, "at", "0 seconds", "2 days", "doc_id")
    return _run(spark, first, "first-copies").select("doc_id", "text")


@register(
    "stream_intake",
    f"WITH {POSTS} SELECT post_id, url FROM ({FIRST_BY_URL.format(key='post_id', rows='posts')}) ORDER BY post_id LIMIT 5000",
)
def stream_intake(spark, folder):
    shape = posts(spark, folder).select("post_id", "url").schema
    intake = Intake(
        spark,
        sink=scratch_path(spark, "intake"),
        checkpoint=scratch_path(spark, "intake-state"),
        schema=T.StructType(shape.fields),
        order=["post_id"],
        target=5000,
        prepare=_as_posts,
    )
    return intake.run(_stream(spark, folder, "documents").select("doc_id"))


def _as_posts(batch):
    i = F.col("doc_id")
    shared = F.when(i % 4 == 3, i).otherwise(i - i % 4)
    url = F.when(i % 97 != 0, F.concat(F.lit("https://p.example/"), shared.cast("string")))
    return batch.select(i.alias("post_id"), url.alias("url"))


@register(
    "stream_intake_uncapped",
    f"WITH {POSTS} SELECT post_id, username, text, url, ts FROM ({FIRST_BY_URL.format(key='post_id', rows='posts')})",
)
def stream_intake_uncapped(spark, folder):
    kept = ["post_id", "username", "text", "url", "ts"]
    intake = Intake(
        spark,
        sink=scratch_path(spark, "intake"),
        checkpoint=scratch_path(spark, "intake-state"),
        schema=posts(spark, folder).select(*kept).schema,
        order=["post_id"],
        prepare=lambda batch: as_posts(batch).select(*kept),
    )
    return intake.run(_stream(spark, folder, "documents"))
