"""Concatenating sources: top-up from a second source, batch merge, mixed tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.functions.dates import shortfall, top_up_request
from tidepost.operators.dedup import keep_first
from tidepost.operators.limits import first_rows
from tidepost.session import through_table

# A pluggable source gives at most ``count`` posts for a keyword:
# ``source(spark, keyword, count)``.
Source = Callable[..., DataFrame]


def concat_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Chunks or files of one schema, one after the other, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_first_schema(parts: Sequence[DataFrame]) -> DataFrame:
    """Files of a batch under the columns of the first; other columns are left out."""
    columns = parts[0].columns
    return reduce(
        lambda a, b: a.unionByName(b.select(*[c for c in b.columns if c in columns]), True), parts
    )


def mixed_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts under the sorted union of their columns."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.select(*sorted(merged.columns))


def missing_rows(rows: DataFrame, target: int) -> DataFrame:
    """One row ``total, missing, ask``: how far ``rows`` is from the target."""
    return rows.agg(F.count("*").alias("total")).select(
        "total",
        shortfall(F.lit(target), F.col("total")).alias("missing"),
        top_up_request(shortfall(F.lit(target), F.col("total"))).alias("ask"),
    )


def fill_to_target(
    sources: Sequence[DataFrame],
    target: int | None,
    order: Sequence[str],
    dedup: bool = True,
    url: str = "url",
) -> DataFrame:
    """Rows of the first source, then of the next ones, up to ``target`` (None: all of them).

    ``order`` orders rows inside a source. With ``dedup`` rows without a URL or
    with one seen before, in this or an earlier source, are skipped.
    """
    ranked = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    if dedup:
        known = rows.where(F.coalesce(F.col(url), F.lit("")) != "")
        rows = keep_first(known, [F.col(url)], ["__source", *order])
    if target is None:
        return rows.drop("__source")
    return first_rows(rows, ["__source", *order], target).drop("__source")


def fill_from_source(
    rows: DataFrame,
    source: Source,
    keywords: Sequence[str],
    target: int,
    order: Sequence[str],
    dedup: bool = True,
    spare: int = 20,
    most: int | None = 150,
) -> DataFrame:
    """Top up from a second source, keyword by keyword in list order.

    Each keyword is asked for what is still missing and ``spare`` more, at most ``most``
    (None: no limit). No keyword is asked once the target is reached. Each round is stored, so
    the work grows with the keywords asked and the rows they bring.
    """
    asked = ["__round", *order]
    filled = through_table(fill_to_target([rows.withColumn("__round", F.lit(0))], target, asked, dedup), "filled")
    for number, keyword in enumerate(keywords, 1):
        missing = target - filled.count()
        if missing <= 0:
            break
        ask = missing + spare if most is None else min(missing + spare, most)
        part = source(rows.sparkSession, keyword, ask).withColumn("__round", F.lit(number))
        # all that is there stays, as it is short of the target; only the new part is looked at
        filled = through_table(fill_to_target([filled, part], target, asked, dedup), "filled")
    return filled.orderBy(*asked).drop("__round")
