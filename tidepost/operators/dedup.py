"""Keep-first deduplication and the joins against rows seen before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """First row of every key in ``order``; ``order`` must identify a row.

    ``min_by`` combines before the shuffle, so a key that holds a third of all
    rows still reaches its reducer as one row per map task.
    """
    packed = F.struct(*[F.col(c) for c in rows.columns])
    first = F.min_by(packed, F.struct(*[F.col(c) for c in order]))
    named = [k.alias(f"__key{i}") for i, k in enumerate(keys)]
    return rows.groupBy(*named).agg(first.alias("__row")).select("__row.*")


def first_by_prefix(
    rows: DataFrame,
    order: Sequence[str],
    text: str = "text",
    characters: int = 50,
    within: Sequence[str] = (),
) -> DataFrame:
    """Same first characters and same length count as one post; NULL text is dropped.

    ``within`` limits the comparison to rows equal in those columns.
    """
    body = F.col(text)
    keys = [*map(F.col, within), F.substring(body, 1, characters), F.length(body)]
    return keep_first(rows.where(body.isNotNull()), keys, order)


def first_by_url(rows: DataFrame, order: Sequence[str], url: str = "url") -> DataFrame:
    """First row of every URL; rows without one are dropped."""
    return keep_first(rows.where(F.coalesce(F.col(url), F.lit("")) != ""), [F.col(url)], order)


def unseen(rows: DataFrame, seen: DataFrame, order: Sequence[str], url: str = "url") -> DataFrame:
    """First row of every URL that ``seen`` does not hold.

    Deduplicating first leaves one row per URL on the left of the anti join.
    """
    return first_by_url(rows, order, url).join(seen.select(url), url, "left_anti").select(
        *rows.columns
    )
