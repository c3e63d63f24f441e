"""Date ranges cut into half-open chunks, and the quota formulas over them.

Chunks are arrays built per row, so one table of ranges is expanded with
``explode`` and never joined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_chunks(start: Column, end: Column, days: Column | int = 7) -> Column:
    """``array<struct<chunk_idx, chunk_start, chunk_end>>``; empty unless start < end."""
    step = days if isinstance(days, Column) else F.lit(days)
    count = F.ceil(F.datediff(end, start) / step).cast("int")

    def chunk(i: Column) -> Column:
        return F.struct(
            i.alias("chunk_idx"),
            F.date_add(start, i * step).alias("chunk_start"),
            F.least(F.date_add(start, (i + 1) * step), end).alias("chunk_end"),
        )

    # a chunk number past the range exists only in the empty case, and is cut here
    numbers = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    return F.transform(F.filter(numbers, lambda i: i < F.coalesce(count, F.lit(0))), chunk)


def adaptive_days(start: Column, end: Column) -> Column:
    """30 days beyond 180, 14 beyond 60, else 7."""
    span = F.datediff(end, start)
    return F.when(span > 180, 30).when(span > 60, 14).otherwise(7)


def adaptive_chunks(start: Column, end: Column) -> Column:
    return date_chunks(start, end, adaptive_days(start, end))


def trailing_chunks(asof: Column, span: int = 120, days: int = 7) -> Column:
    return date_chunks(F.date_sub(asof, span), asof, days)


def weekly_chunks_if_long(start: Column, end: Column, days: int = 7, minimum: int = 7) -> Column:
    """Chunks only for a range longer than ``minimum`` days, else one whole range."""
    whole = F.array(
        F.struct(
            F.lit(0).alias("chunk_idx"), start.alias("chunk_start"), end.alias("chunk_end")
        )
    )
    return F.when(F.datediff(end, start) > minimum, date_chunks(start, end, days)).otherwise(whole)


def _as_text(chunks: Column) -> Column:
    return F.transform(
        chunks,
        lambda c: F.struct(
            c["chunk_idx"].alias("chunk_idx"),
            c["chunk_start"].cast("string").alias("chunk_start"),
            c["chunk_end"].cast("string").alias("chunk_end"),
        ),
    )


def planned_chunks(start: Column, end: Column, asof: Column, span: int = 120) -> Column:
    """Chunks of a job given as text dates.

    Both dates given: adaptive chunks. One missing or empty: trailing weekly
    chunks before ``asof``. Unreadable: one chunk that carries the raw text.
    """
    start_day = F.try_to_date(start, "yyyy-M-d")
    end_day = F.try_to_date(end, "yyyy-M-d")
    raw = F.array(
        F.struct(
            F.lit(0).alias("chunk_idx"), start.alias("chunk_start"), end.alias("chunk_end")
        )
    )
    given = (F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != "")
    return (
        F.when(~given, _as_text(trailing_chunks(asof, span)))
        .when(start_day.isNull() | end_day.isNull(), raw)
        .otherwise(_as_text(adaptive_chunks(start_day, end_day)))
    )


def quota_per_chunk(count: Column, chunks: Column) -> Column:
    return F.floor(count / F.nullif(chunks, F.lit(0))).cast("bigint")


def is_unlimited(count: Column, has_dates: Column) -> Column:
    return ((count == 0) | (count >= 10000)) & has_dates


def planned_quota(count: Column, items: Column, has_dates: Column) -> Column:
    """Rows to ask per work item, between 30 and 200; 200 when unlimited."""
    cap = F.when(count > 0, count).otherwise(999999)
    share = F.floor(cap * F.lit(2.5) / F.nullif(items, F.lit(0))).cast("bigint")
    return F.when(is_unlimited(count, has_dates), F.lit(200)).otherwise(
        F.greatest(F.lit(30), F.least(F.lit(200), share))
    ).cast("bigint")


def remaining_quota(target: Column, collected: Column, items_left: Column, minimum: int = 50) -> Column:
    """Rows the next item should bring: an even share of the rest, at least ``minimum``."""
    rest = target - collected
    share = F.ceil(rest / F.greatest(F.lit(1), items_left))
    return F.when(rest <= 0, F.lit(0)).otherwise(F.greatest(F.lit(minimum), share)).cast("bigint")


def shortfall(target: Column, total: Column) -> Column:
    return F.greatest(F.lit(0), target - total).cast("bigint")


def top_up_request(missing: Column) -> Column:
    """Rows to ask of the second source, with slack for duplicates."""
    return F.least(missing + 20, F.lit(150))


def rate_percent(requests: Column, limit: int) -> Column:
    return F.least(F.lit(100), F.floor(requests / F.lit(limit) * 100)).cast("int")


def rate_level(requests: Column, warning: int, danger: int) -> Column:
    return (
        F.when(requests >= danger, "HOT").when(requests >= warning, "WARM").otherwise("COOL")
    )


def rate_color(requests: Column, warning: int, danger: int) -> Column:
    return (
        F.when(requests >= danger, "red").when(requests >= warning, "yellow").otherwise("green")
    )
