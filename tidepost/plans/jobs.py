"""The two job kinds as one lazy DataFrame each, over a table of posts.

``posts`` needs ``post_id, text, url, ts, lang, is_reply`` and may hold more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tidepost.functions.dates import planned_chunks
from tidepost.functions.predicates import (
    account_allowed,
    contains_any,
    in_range,
    long_enough,
    mostly_latin,
)
from tidepost.operators.dedup import first_by_prefix, first_by_url, keep_first
from tidepost.operators.discovery import expand_keywords, tag_counts
from tidepost.operators.limits import first_rows, quota_per_group
from tidepost.operators.ranking import top_terms, with_rank
from tidepost.functions.text import text_column
from tidepost.operators.sentiment import Model, with_lexicon_sentiment, with_model_sentiment
from tidepost.operators.state import completed_batch_files
from tidepost.operators.topics import lda_topics
from tidepost.plans.fill import fill_to_target, merge_first_schema
from tidepost.plans.waves import run_waves
from tidepost.plans.work import first_matches, match_posts, work_items
from tidepost.session import through_table
from tidepost.sources.readers import read_csv_posts, read_posts, read_result
from tidepost.sources.writers import write_csv


# Most variations of a job; days read when no dates are given.
VARIATIONS = 60
TRAILING_DAYS = 120


#: Columns of a row's key while a job runs.
ROW = ["__row_1", "__row_2"]


def row_key(rows: DataFrame) -> list[Column]:
    """Two hashes over all columns and which of them are null: equal for equal rows only."""
    parts = [F.to_json(F.col(c)) if isinstance(f.dataType, MapType) else F.col(c) for c, f in zip(rows.columns, rows.schema)]
    parts += [F.col(c).isNull() for c in rows.columns]
    return [F.xxhash64(F.lit(salt), *parts) for salt in (0, 1)]


def originals(posts: DataFrame, lang: str | None = None) -> DataFrame:
    """Posts that are no replies, in one language if given."""
    kept = posts.where(~F.coalesce("is_reply", F.lit(False)))
    return kept.where(F.col("lang") == lang) if lang else kept


def search(
    posts: DataFrame,
    keywords: Sequence[str],
    start: Column | None = None,
    end: Column | None = None,
    lang: str | None = None,
) -> DataFrame:
    """Original posts with any keyword, in the half-open date range."""
    return originals(posts, lang).where(
        in_range(F.col("ts"), start, end) & contains_any(F.col("text"), keywords)
    )


def readable(
    posts: DataFrame, order: Sequence[str] = ("post_id",), session: Sequence[str] = ()
) -> DataFrame:
    """Intake rules in their order: near-copies go first, so a dropped first copy
    also hides later ones; then blocked accounts, script and quality.

    ``session`` names the columns of one collection session; copies are only
    looked for inside it.
    """
    return first_by_prefix(posts, order, within=session).where(passes_intake(posts.columns))


def passes_intake(columns: Sequence[str]) -> Column:
    """Account (if the posts have one), script and quality rules."""
    rules = mostly_latin(F.col("text")) & long_enough(F.col("text"))
    return account_allowed(F.col("username")) & rules if "username" in columns else rules


def expand_job(
    posts: DataFrame,
    keywords: Sequence[str],
    start: str | None,
    end: str | None,
    asof: str,
    count: int,
    lang: str | None = None,
    top_up: Sequence[DataFrame] = (),
    sample: DataFrame | None = None,
    limit: int = VARIATIONS,
    unlimited: bool = False,
) -> DataFrame:
    """Expand, plan, match, clean, deduplicate, top up and cut at ``count``.

    ``unlimited`` (or ``count`` 0) means no cap and no top-up. ``sample`` is the
    discovery input; all original posts if not given. ``limit`` is the most variations.
    Dates that cannot be read make one chunk without a range, which matches every
    post. Top-up rows carry a ``post_id`` that orders them. Posts are told apart by all their
    columns, so null and repeated ids lose and multiply none; among posts alike in the
    order, a hash of the row decides.
    """
    source = originals(posts, lang)
    discovery = sample if sample is not None else source
    # at most ``limit`` rows, read several times by the plan that follows
    variations = through_table(
        expand_keywords(discovery, "post_id", keywords, limit=limit), "variations"
    )
    chunks = planned_chunks(F.lit(start), F.lit(end), F.lit(asof).cast("date"), TRAILING_DAYS)
    items = work_items(variations, chunks)
    plan = posts.sparkSession.range(1).select(
        F.exists(chunks, lambda c: c["chunk_start"].try_cast("date").isNull()).alias("undated")
    )
    # Each post is judged once; matching, copies and the cap then run on narrow rows.
    judged = source.withColumns(
        {
            **dict(zip(ROW, row_key(source))),
            "__start": F.substring("text", 1, 50),
            "__size": F.length("text"),
            "__passes": passes_intake(posts.columns),
        }
    )
    order = ["post_id", *ROW]
    matches = match_posts(
        judged,
        items,
        undated=bool(plan.first()["undated"]),
        keep=[*order, "url", "__start", "__size", "__passes"],
    )
    copies = [F.col("work_idx"), F.col("__start"), F.col("__size")]
    sessions = keep_first(matches.where(F.col("__size").isNotNull()), copies, order)
    firsts = first_matches(sessions.where("__passes"), order).select(
        *order, "work_idx", "variation_idx", "chunk_idx"
    )
    if not unlimited and count:
        firsts = first_rows(firsts, ["work_idx", *order], count)
    # wholly equal rows share a URL, of which one match is left: one of them comes back
    found = (
        source.withColumns(dict(zip(ROW, row_key(source))))
        .join(firsts.drop("post_id"), ROW)
        .dropDuplicates(ROW)
        .select(*source.columns, "work_idx", "variation_idx", "chunk_idx")
    )
    if unlimited or not count or not top_up:
        return found
    return fill_to_target([found, *top_up], count, ["work_idx", "post_id"])


def standard_job(
    posts: DataFrame,
    keywords: Sequence[str],
    start: str | None,
    end: str | None,
    count: int | None,
    top_up: Sequence[DataFrame] = (),
    quota: int | None = None,
    smart: int | None = None,
) -> DataFrame:
    """One search; a range over a week is read in weekly chunks with equal quotas.

    Without both dates, or with one that can't be read, the whole table is one search. ``count``
    None means no cap and no top-up, and quotas only if ``quota`` gives the rows of a chunk: without either, chunks
    bound only where near-copies are looked for. The top-up of this job keeps duplicates, the
    chunks do not. With ``smart``, the top hashtags of that many first readable posts with a
    keyword, of any date, are searched for too.
    """
    if smart:
        keywords = [*keywords, *related_tags(posts, keywords, smart)]
    dated = bool(start and end)
    # dates as the plan reads them; a range that can't be read is none
    first, last = _day(start) if dated else None, _day(end) if dated else None
    dated = first is not None and last is not None
    begin, stop = (F.lit(first), F.lit(last)) if dated else (None, None)
    found = search(posts, keywords, begin, stop)
    span = (last - first).days if dated else 0
    if span > 7:
        # each chunk is a collection session of its own, with its own memory of near-copies
        n_chunks = -(-span // 7)
        chunk = F.floor(F.datediff(F.to_date("ts"), begin) / 7).cast("int")
        chunked = readable(found.withColumn("chunk_idx", chunk), session=["chunk_idx"])
        if quota is None and count is not None:
            quota = count // n_chunks
        if quota is not None:
            chunked = quota_per_group(chunked, "chunk_idx", ["post_id"], quota)
        found = first_by_url(chunked, ["post_id"]).drop("chunk_idx")
    else:
        found = readable(found)
    if count is None:
        return found
    if not top_up:
        return first_rows(found, ["post_id"], count)
    return fill_to_target([found, *top_up], count, ["post_id"], dedup=False)


def related_tags(posts: DataFrame, keywords: Sequence[str], sample: int = 100, tags: int = 10) -> list[str]:
    """The ``tags`` most used hashtags of the first ``sample`` readable posts with a keyword (ties: earlier first)."""
    found = first_rows(readable(search(posts, keywords)).select("post_id", "text"), ["post_id"], sample)
    top = with_rank(top_terms(tag_counts(found, "post_id"), tags)).orderBy("rank")
    return [r["term"] for r in top.collect()]  # at most ``tags`` rows


def expand_job_in_waves(
    posts: DataFrame,
    keywords: Sequence[str],
    start: str | None,
    end: str | None,
    asof: str,
    target: int,
    folder: str,
    lang: str | None = None,
    limit: int = VARIATIONS,
    most_waves: int | None = None,
    **sizes: int,
) -> DataFrame:
    """The expand job with quotas that follow what was collected: ``post_id, url, work_idx, wave``.

    ``folder`` holds the plan, the candidates and the waves; a call on the same folder goes on where the
    last one stopped. ``sizes`` goes to ``run_waves``.
    """
    spark = posts.sparkSession
    source = originals(posts, lang)
    if not _exists(spark, f"{folder}/candidates/_SUCCESS"):
        variations = through_table(expand_keywords(source, "post_id", keywords, limit=limit), "variations")
        chunks = planned_chunks(F.lit(start), F.lit(end), F.lit(asof).cast("date"), TRAILING_DAYS)
        work_items(variations, chunks).write.mode("overwrite").parquet(f"{folder}/items")
        items = spark.read.parquet(f"{folder}/items")
        undated = not items.where(F.col("chunk_start").try_cast("date").isNull()).isEmpty()
        judged = source.withColumns(
            {**dict(zip(ROW, row_key(source))), "__start": F.substring("text", 1, 50), "__size": F.length("text"), "__passes": passes_intake(posts.columns)}
        )
        matches = match_posts(judged, items, undated=undated, keep=["post_id", *ROW, "url", "__start", "__size", "__passes"])
        copies = [F.col("work_idx"), F.col("__start"), F.col("__size")]
        sessions = keep_first(matches.where(F.col("__size").isNotNull()), copies, ["post_id", *ROW]).where("__passes")
        sessions.select("post_id", *ROW, "url", "work_idx").write.mode("overwrite").parquet(f"{folder}/candidates")
    items = spark.read.parquet(f"{folder}/items").count()
    candidates = spark.read.parquet(f"{folder}/candidates")
    found = run_waves(candidates, items, target, f"{folder}/waves", ["post_id", *ROW], most_waves=most_waves, **sizes)
    return found.select("post_id", "url", "work_idx", "wave")


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def merge_finished_batches(spark: SparkSession, jobs: DataFrame, folder: str) -> DataFrame:
    """Merge the result files of every finished batch into one headed CSV below ``folder``; one row per merged batch.

    ``jobs`` has ``batch_id, done, result_file``. Gives ``batch_id, files, rows, merged_file``. Files that are
    missing, unreadable or of another kind are left out; a batch without a row gives none. Columns are
    those of the first file by name; a batch that was merged before is not merged again. One
    batch's file names reach the driver at a time.
    """
    files = through_table(completed_batch_files(jobs).distinct(), "batch-files")
    out = []
    for batch in [r["batch_id"] for r in files.select("batch_id").distinct().orderBy("batch_id").collect()]:
        target = f"{folder}/batch_{batch}"
        names = [r["result_file"] for r in files.where(F.col("batch_id").eqNullSafe(F.lit(batch))).orderBy("result_file").collect()]
        parts = [p for p in (read_result(spark, n) for n in names) if p is not None]
        if not parts:
            continue
        if not _exists(spark, f"{target}/_SUCCESS"):
            write_csv(merge_first_schema(parts), target, mode="overwrite")
        rows = read_csv_posts(spark, target).count()
        if rows:
            out.append((batch, len(parts), rows, target))
    kind = jobs.schema["batch_id"].dataType.simpleString()
    return spark.createDataFrame(out, f"batch_id {kind}, files int, rows long, merged_file string")


def score_table(
    spark: SparkSession, source: str, result: str, load_model: Callable[[], Model] | None = None
) -> DataFrame:
    """Stored posts with sentiment columns, written to a new path as CSV.

    Scores with the lexicon, or with the model if one is given.
    """
    rows = read_posts(spark, [source])
    scored = with_model_sentiment(rows, load_model) if load_model else with_lexicon_sentiment(rows)
    write_csv(scored, result)
    return scored


def topics_of_table(
    spark: SparkSession, source: str, ord: str, topics: int = 5, words_per_topic: int = 10
) -> DataFrame:
    """LDA topics of the stored posts that have text; ``ord`` is the column that orders them."""
    rows = read_posts(spark, [source])
    body = text_column(rows.columns)
    return lda_topics(rows.where(F.coalesce(body, F.lit("")) != ""), ord, topics, words_per_topic)


def _day(text: str) -> date | None:
    """The day of a text like 2024-1-31 (with or without leading zeros); None if it is none."""
    try:
        return datetime.strptime(text.strip(), "%Y-%m-%d").date()
    except ValueError:
        return None
