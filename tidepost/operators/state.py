"""Job, batch, checkpoint and log tables: latest state and small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.functions.text import job_keyword
from tidepost.operators.limits import last_rows

# States in which a job counts as active.
ACTIVE = ("RUNNING", "PENDING")


def latest_jobs(updates: DataFrame) -> DataFrame:
    """Current row of each job from its updates, in ``seq`` order.

    A row with ``created_at`` adds the job and sets its fixed fields; rows
    before the newest one no longer count. Status is the newest given; progress
    and result keep their last non-empty value; a cancel request sticks. A job
    whose newest add is followed by a removal is gone.
    """
    seq = F.col("seq")
    live = (
        updates.groupBy("id")
        .agg(
            F.max(F.when(F.col("created_at").isNotNull(), seq)).alias("__start"),
            F.max(F.when(F.col("removed"), seq)).alias("__gone"),
        )
        .where(F.col("__gone").isNull() | (F.col("__start") > F.col("__gone")))
        .where(F.col("__start").isNotNull())
        .drop("__gone")
    )
    current = updates.join(live, "id").where(seq >= F.col("__start"))
    added = seq == F.col("__start")

    def last_given(name: str) -> Column:
        given = F.coalesce(F.col(name), F.lit("")) != ""
        return F.max_by(name, F.when(given, seq)).alias(name)

    def when_added(name: str) -> Column:
        return F.max(F.when(added, F.col(name))).alias(name)

    return current.groupBy("id").agg(
        when_added("keyword"),
        when_added("target_count"),
        last_given("status"),
        last_given("progress"),
        last_given("result_file"),
        when_added("created_at"),
        when_added("worker_mode"),
        F.bool_or(F.coalesce("cancel_requested", F.lit(False))).alias("cancel_requested"),
    )


def recent_jobs(jobs: DataFrame, count: int = 10) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.asc("id")).limit(count)


def cancelled(jobs: DataFrame) -> DataFrame:
    return jobs.where("cancel_requested")


def active_duplicates(
    requests: DataFrame, jobs: DataFrame, decorations: Sequence[str] = ()
) -> DataFrame:
    """Requests whose keyword an active job is already working on."""
    active = (
        jobs.where(F.col("status").isin(*ACTIVE))
        .select(job_keyword(F.col("keyword"), decorations).alias("__k"))
        .distinct()
    )
    wanted = requests.withColumn("__k", F.lower("keyword"))
    return wanted.join(active, "__k", "left_semi").drop("__k")


def completed_batch_files(jobs: DataFrame) -> DataFrame:
    """``batch_id, result_file`` of every batch whose jobs are all done.

    ``jobs`` has ``batch_id, done, result_file``. Files stay rows, so a batch of
    any size is never gathered in one place.
    """
    done = (
        jobs.groupBy("batch_id")
        .agg(F.count("*").alias("total"), F.count_if("done").alias("completed"))
        .where(F.col("total") == F.col("completed"))
    )
    return (
        jobs.where(F.coalesce("result_file", F.lit("")) != "")
        .join(done, "batch_id", "left_semi")
        .select("batch_id", "result_file")
    )


def checkpoint_summary(checkpoints: DataFrame) -> DataFrame:
    """Report row per stored checkpoint; needs the ``file`` column of the reader."""
    name = F.substring_index("file", "/", -1)
    return checkpoints.select(
        F.regexp_replace(name, r"\.json$", "").alias("job_id"),
        F.coalesce("base_keyword", F.lit("Unknown")).alias("keyword"),
        F.concat_ws(
            "/",
            F.coalesce(F.col("current_chunk_idx").cast("string"), F.lit("0")),
            F.coalesce(F.col("total_chunks").cast("string"), F.lit("?")),
        ).alias("progress"),
        F.coalesce(F.size("all_tweets"), F.lit(0)).alias("tweets_collected"),
        F.coalesce("saved_at", F.lit("Unknown")).alias("saved_at"),
        F.coalesce("worker_mode", F.lit(3)).alias("worker_mode"),
    )


def log_tail(logs: DataFrame, key: str, buffer: int = 100, count: int = 50) -> DataFrame:
    """Newest ``count`` lines of the ring buffer, oldest first."""
    return last_rows(logs, key, min(buffer, count))
