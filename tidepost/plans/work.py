"""Work items of a keyword expansion: plan, match against posts, yield, quota."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepost.functions.dates import planned_quota, quota_per_chunk, remaining_quota
from tidepost.functions.text import filter_words
from tidepost.operators.dedup import keep_first
from tidepost.operators.grams import with_found_terms
from tidepost.session import through_table

NO_DAY = -(1 << 31)
RANGE = ["__from", "__to"]
#: Most bytes, as JSON, of a table of the plan that is broadcast; what a row adds to its array.
MOST_BYTES, ROW_BYTES = 8 << 20, 32


def work_items(variations: DataFrame, chunks: Column) -> DataFrame:
    """Every variation with every chunk, numbered variation by variation.

    ``chunks`` is an array column (see ``functions.dates``), so pairs come from
    ``explode`` and no join is planned.
    """
    listed = variations.withColumn("__chunks", chunks)
    n_chunks = F.size("__chunks")
    return (
        listed.withColumn("__n", n_chunks)
        .select("*", F.explode("__chunks").alias("__chunk"))
        .select(
            (F.col("variation_idx") * F.col("__n") + F.col("__chunk.chunk_idx")).alias("work_idx"),
            *[c for c in variations.columns],
            "__chunk.chunk_idx",
            "__chunk.chunk_start",
            "__chunk.chunk_end",
        )
    )


def unfinished(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items without a row in the ledger of finished items; gaps are kept."""
    done = ledger.select("work_idx").distinct()  # a ledger may hold an item once per post
    return items.join(done, "work_idx", "left_anti").select(*items.columns)


def from_index(items: DataFrame, start: int | Column) -> DataFrame:
    """Items from an index on: the coarser way to resume."""
    return items.where(F.col("work_idx") >= start)


def match_posts(
    posts: DataFrame,
    items: DataFrame,
    text: str = "text",
    ts: str = "ts",
    undated: bool = False,
    keep: Sequence[str] | None = None,
    salts: int = 16,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Posts each item asks for: in its date range, with one of its words.

    ``posts`` must not already hold the item columns. Each distinct word of the plan is
    looked up once per post, before any join (see ``operators.grams``). A post's day then gives
    the date ranges it lies in, and each range its items as one array, whose words are tested against
    the words found. ``keep`` names the columns of ``posts`` that the result holds
    (by default all); without the text among them, no text is ever shuffled.

    So a plan is held once per item and once per day of each distinct range, never per item and
    day. Both tables are stored and measured: up to ``most_bytes`` a table is broadcast, beyond
    that both sides are shuffled by key and salt, so a busy range is spread over ``salts`` tasks.
    Items whose dates cannot be read match nothing, or with ``undated`` every post, those
    without a time too.
    """
    words = F.array_distinct(F.transform(filter_words(F.col("variation")), F.lower))
    first, last = F.col("chunk_start").try_cast("date"), F.col("chunk_end").try_cast("date")
    loose = first.isNull() | last.isNull()
    # items without dates stand in a range of their own, which no day has
    bounds = [F.when(loose, F.lit(NO_DAY)).otherwise(F.unix_date(d)) for d in (first, last)]
    item = F.struct("work_idx", "variation_idx", "chunk_idx", "words").alias("item")
    worded = items.withColumn("words", words)
    ranged = worded.where(loose | (first < last) if undated else first < last).select(
        *[b.alias(n) for b, n in zip(bounds, RANGE)], item
    )
    by_range = through_table(ranged.groupBy(*RANGE).agg(F.collect_list("item").alias("__items")), "items-by-range")
    days = F.explode(F.sequence("__from", F.col("__to") - 1)).alias("__day")
    dated = by_range.where(F.col("__from") < F.col("__to")).select(days, F.struct(*RANGE).alias("range"))
    by_day = through_table(dated.groupBy("__day").agg(F.collect_list("range").alias("__ranges")), "ranges-by-day")
    kept = list(keep) if keep is not None else posts.columns
    known = worded.select(F.explode("words").alias("term"))
    looked_up = with_found_terms(posts, F.col(text), known, "__found").select(
        *kept,
        F.unix_date(F.to_date(ts)).alias("__day"),
        # the same for a repeated task, and spread over any one day or text
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt"),
        "__found",
    )
    if undated:
        # posts of no day that is asked for, and those without a time, are in the range of these items
        everywhere = F.array(F.struct(*[F.lit(NO_DAY).alias(n) for n in RANGE]))
        asked = _joined(looked_up, by_day, ["__day"], "__ranges", salts, most_bytes, "left")
        ranges = F.concat(F.coalesce("__ranges", F.filter(everywhere, lambda r: F.lit(False))), everywhere)
    else:
        asked = _joined(looked_up, by_day, ["__day"], "__ranges", salts, most_bytes, "inner")
        ranges = F.col("__ranges")
    in_range = asked.select(*kept, "__salt", "__found", F.explode(ranges).alias("__range")).select(
        *kept, "__salt", "__found", "__range.*"
    )
    # an item without words keeps every post of its range
    wanted = F.filter(
        "__items",
        lambda i: (F.size(i["words"]) == 0) | F.arrays_overlap(i["words"], F.col("__found")),
    )
    return (
        _joined(in_range, by_range, RANGE, "__items", salts, most_bytes, "inner")
        .select(*kept, F.explode(wanted).alias("__item"))
        .select(*kept, "__item.work_idx", "__item.variation_idx", "__item.chunk_idx")
    )


def _joined(
    rows: DataFrame, stored: DataFrame, keys: list[str], column: str, salts: int, most_bytes: int, how: str
) -> DataFrame:
    """``rows`` with the array ``column`` of a stored table, one row per key there.

    Spark's own choice goes by the size of the files, which says little of arrays; a broadcast that it
    plans by them stays even if the table turns out large. Hence the measured bytes.
    """
    size = stored.agg(F.sum(ROW_BYTES + F.octet_length(F.to_json(column)))).first()[0] or 0
    if size <= most_bytes:
        return rows.join(F.broadcast(stored), keys, how)
    salted = stored.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(salted.hint("merge"), [*keys, "__salt"], how)


def first_matches(matches: DataFrame, order: list[str], url: str = "url") -> DataFrame:
    """One row per URL: the match of the earliest item, then of the earliest post."""
    known = matches.where(F.coalesce(F.col(url), F.lit("")) != "")
    return keep_first(known, [F.col(url)], ["work_idx", *order])


def work_yield(matches: DataFrame, url: str = "url") -> DataFrame:
    """``work_idx, fetched, new_unique`` of every item that matched a post.

    A URL is new for the earliest item that found it. Matches are counted per
    URL and item first, so the window sees at most one row per item of a URL.
    """
    counted = matches.groupBy(F.col(url).alias("__url"), "work_idx").agg(F.count("*").alias("__n"))
    first = F.min("work_idx").over(Window.partitionBy("__url"))
    is_new = (F.coalesce("__url", F.lit("")) != "") & (F.col("work_idx") == F.col("__first"))
    return (
        counted.withColumn("__first", first)
        .groupBy("work_idx")
        .agg(F.sum("__n").alias("fetched"), F.count_if(is_new).alias("new_unique"))
    )


def dynamic_quota(items: DataFrame, yields: DataFrame, target: int, minimum: int = 50) -> DataFrame:
    """Rows to ask of each item, given what the items before it brought.

    The window runs over the item table (variations x chunks), never over posts.
    """
    before = Window.orderBy("work_idx").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("work_idx"))
    listed = items.select("work_idx").join(yields.select("work_idx", "new_unique"), "work_idx", "left")
    brought = F.coalesce("new_unique", F.lit(0))
    return (
        listed.withColumns(
            {
                "collected": F.coalesce(F.sum(brought).over(before), F.lit(0)).cast("bigint"),
                "items_left": F.row_number().over(after),
            }
        )
        .withColumn(
            "quota",
            remaining_quota(F.lit(target), F.col("collected"), F.col("items_left"), minimum),
        )
        .select("work_idx", "collected", "items_left", "quota")
    )


def with_planned_quota(jobs: DataFrame) -> DataFrame:
    """Add ``chunk_quota`` and ``item_quota`` to jobs with counts of their plan.

    Needs ``count, n_chunks, n_items, has_dates``.
    """
    return jobs.withColumns(
        {
            "chunk_quota": quota_per_chunk(F.col("count"), F.col("n_chunks")),
            "item_quota": planned_quota(F.col("count"), F.col("n_items"), F.col("has_dates")),
        }
    )
