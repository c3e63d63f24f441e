"""Queries over stored results: the ledger of a job, scored and analysed files, pages in SQL, posts by day."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepost.catalog.registry import ORACLES, documents, posts, register, span_of, table
from tidepost.catalog.work import ITEMS, _items
from tidepost.functions import text as X
from tidepost.plans import jobs, work
from tidepost.session import scratch_path
from tidepost.sources.days import days_per_folder, in_days_of, read_days, write_by_day
from tidepost.sources.ledger import Ledger
from tidepost.sources.page_function import register_page_records
from tidepost.sources.writers import write_json


def _ledger(spark, folder):
    """Items and a ledger with those that match some posts; rows of a forgotten run and of another job don't count."""
    rows, items = _items(spark, folder)
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    none = F.lit(0).cast("long")
    ledger.save("job", items.select("work_idx", none.alias("fetched"), none.alias("new_unique")))
    ledger.delete("job")
    ledger.save("other", items.select("work_idx", none.alias("fetched"), none.alias("new_unique")))
    done = work.work_yield(work.match_posts(rows.where("post_id % 50 = 7"), items, keep=["url"]))
    ledger.save("job", done)
    ledger.save("job", done.limit(3))  # an item saved again counts once
    return items, ledger


@register(
    "ledger_resume",
    f"""WITH {ITEMS} SELECT work_idx, variation FROM items
    WHERE work_idx NOT IN (SELECT work_idx FROM matches WHERE post_id % 50 = 7)""",
)
def ledger_resume(spark, folder):
    items, ledger = _ledger(spark, folder)
    return work.unfinished(items, ledger.load("job")).select(F.col("work_idx").cast("bigint").alias("work_idx"), "variation")


@register(
    "ledger_highest",
    f"WITH {ITEMS} SELECT max(work_idx) AS highest, count(DISTINCT work_idx) AS finished FROM matches WHERE post_id % 50 = 7",
)
def ledger_highest(spark, folder):
    _, ledger = _ledger(spark, folder)
    finished = ledger.load("job").agg(F.count("*").alias("finished"))
    return ledger.highest("job").crossJoin(F.broadcast(finished))  # one row each


@register("stored_sentiment", ORACLES["lexicon_sentiment"])
def stored_sentiment(spark, folder):
    path = scratch_path(spark, "unscored")
    posts(spark, folder).select("post_id", "text").write.parquet(path + ".parquet")
    scored = jobs.score_table(spark, path + ".parquet", path + "-scored.csv")
    return scored.select("post_id", "sentiment", "sentiment_score")


@register("stored_topics", ORACLES["lda_topics"])
def stored_topics(spark, folder):
    path = scratch_path(spark, "posts") + ".jsonl"
    write_json(documents(spark, folder).select("text", F.col("doc_id").alias("replies")), path)
    found = jobs.topics_of_table(spark, path, "replies")
    return found.select("id", F.array_join("words", " ").alias("words"), "weight")


@register("page_records_sql", ORACLES["page_records"])
def page_records_sql(spark, folder):
    """The records of saved pages by a lateral join in SQL."""
    register_page_records(spark)
    view = f"pages_{uuid.uuid4().hex}"
    table(spark, folder, "pages").createOrReplaceTempView(view)
    found = spark.sql(
        f"""SELECT p.page_id, r.pos, r.url, r.title, r.body FROM {view} p,
        LATERAL page_records(p.html, 'li', 'title=a; body=.; url=a@href') r WHERE r.title <> '' AND r.url <> ''"""
    )
    return found.select("page_id", "pos", "url", X.search_row_text(F.col("title"), F.col("body")).alias("text"))


@register("match_posts_by_day", ORACLES["match_posts"])
def match_posts_by_day(spark, folder):
    """Posts stored by day; only the files of days that work items ask for are read."""
    rows, items = _items(spark, folder)
    path = scratch_path(spark, "posts-by-day")
    days = days_per_folder(*span_of(rows))
    write_by_day(rows, path, days=days)
    asked = in_days_of(read_days(spark, path, rows.schema), items, days=days)
    return work.match_posts(asked, items, keep=["post_id"]).select(F.col("work_idx").cast("bigint").alias("work_idx"), "post_id")
