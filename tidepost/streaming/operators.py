"""Stateful operators over event time: near-copy dedup, rate, loops of a job.

Rows later than the watermark are dropped by these operators; where nothing may
be lost, use :class:`tidepost.streaming.intake.Intake`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.functions.dates import rate_color, rate_level, rate_percent
from tidepost.functions.fixed_values import RATE_DANGER, RATE_LIMIT, RATE_WARNING


def first_by_prefix(
    posts: DataFrame,
    ts: str,
    delay: str,
    spread: str,
    text: str = "text",
    characters: int = 50,
    salts: int = 32,
) -> DataFrame:
    """One post per (first characters, length) within ``delay`` of event time.

    ``spread`` is an id column. Copies are first dropped in ``salts`` parts of
    each key, so a text that a third of all posts repeat is spread over as many
    tasks before its few survivors meet.
    """
    keyed = posts.where(F.col(text).isNotNull()).withColumns(
        {
            "prefix": F.substring(text, 1, characters),
            "size": F.length(text),
            "__salt": F.pmod(F.xxhash64(spread), F.lit(salts)),
        }
    )
    return (
        keyed.withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark(["prefix", "size", "__salt"])
        .dropDuplicatesWithinWatermark(["prefix", "size"])
        .drop("__salt")
    )


def first_copies(
    posts: DataFrame, ts: str, delay: str, horizon: str, order: str, text: str = "text", characters: int = 50
) -> DataFrame:
    """The first post of every (first characters, length) in each slice of ``horizon`` of time, columns unchanged.

    First by ``ts``, then by ``order``, whatever the order of arrival within ``delay``; given out once
    the watermark has passed the slice, when its state goes. So the state is bounded by the
    keys of one slice and the delay, and the result is that of the batch form, which is the
    same call on a table. Copies combine before the shuffle. Null texts and times are dropped.
    """
    keyed = posts.where(F.col(text).isNotNull() & F.col(ts).isNotNull())
    first = F.min_by(F.struct(*[F.col(c) for c in posts.columns]), F.struct(ts, order))
    return (
        keyed.withWatermark(ts, delay)
        .groupBy(F.window(ts, horizon), F.substring(text, 1, characters).alias("prefix"), F.length(text).alias("size"))
        .agg(first.alias("post"))
        .select("post.*")
    )


def rolling_rate(
    requests: DataFrame,
    ts: str = "ts",
    delay: str = "0 seconds",
    width: str = "60 seconds",
    slide: str = "5 seconds",
    limit: int = RATE_LIMIT,
    warning: int = RATE_WARNING,
    danger: int = RATE_DANGER,
) -> DataFrame:
    """Requests, level and percent of every sliding window, once it is complete."""
    counted = (
        requests.withWatermark(ts, delay)
        .groupBy(F.window(ts, width, slide))
        .agg(F.count("*").alias("requests"))
    )
    n = F.col("requests")
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "requests",
        rate_level(n, warning, danger).alias("status"),
        rate_color(n, warning, danger).alias("color"),
        rate_percent(n, limit).alias("percent"),
    )


def loop_counts(
    rows: DataFrame, job: str, ts: str, loop_seconds: int = 60, delay: str = "0 seconds"
) -> DataFrame:
    """``job, loop, new_rows`` of every finished loop that brought a row."""
    return (
        rows.withWatermark(ts, delay)
        .groupBy(F.col(job).alias("job"), F.window(ts, f"{loop_seconds} seconds").alias("w"))
        .agg(F.count("*").alias("new_rows"))
        .select("job", F.unix_seconds("w.start").alias("loop"), "new_rows")
    )
