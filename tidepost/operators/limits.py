"""Row limits: ordered caps, per-group quotas, head and tail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(
    rows: DataFrame, order: Sequence[Column | str], count: int, keys_first: bool = False
) -> DataFrame:
    """The first ``count`` rows in ``order``.

    A top-k brings up to ``count`` rows of every task together. For wide rows and a large
    count over ascending column names, ``keys_first`` finds the last wanted key on the
    key columns alone and then brings only rows up to it together; that reads ``rows`` twice.
    """
    if keys_first:
        keys = rows.select(*order).orderBy(*order).limit(count)
        last = keys.agg(F.max(F.struct(*order))).scalar()
        rows = rows.where(F.struct(*order) <= last)
    return rows.orderBy(*order).limit(count)


def last_rows(rows: DataFrame, key: str, count: int) -> DataFrame:
    """The last ``count`` rows by ``key``, given back in ascending order."""
    return rows.orderBy(F.desc(key)).limit(count).orderBy(F.asc(key))


def quota_per_group(
    rows: DataFrame,
    group: str,
    order: Sequence[str],
    quota: int | str,
    salts: int = 64,
) -> DataFrame:
    """At most ``quota`` rows (a number or a column) of each group, in ``order``.

    A row within the group's quota is also within it inside any part of the
    group, so each group is first cut in ``salts`` parts on as many tasks and
    only the survivors meet in one.
    """
    limit = F.lit(quota) if isinstance(quota, int) else F.col(quota)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts))
    by_part = Window.partitionBy(group, "__salt").orderBy(*order)
    by_group = Window.partitionBy(group).orderBy(*order)
    return (
        rows.withColumn("__salt", salt)
        .withColumn("__n", F.row_number().over(by_part))
        .where(F.col("__n") <= limit)
        .withColumn("__n", F.row_number().over(by_group))
        .where(F.col("__n") <= limit)
        .drop("__salt", "__n")
    )
