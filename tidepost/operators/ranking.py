"""Frequencies and top-k with ties broken by first appearance.

Position of a term is ``(ord, pos)``: the post's order key and the place in the
post. Both are packed into one decimal, which a hash aggregate can keep in its
fixed-width buffer; a struct or ``min_by`` would force a sort of every
exploded term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIONS = 1 << 31


def explode_terms(posts: DataFrame, terms: Column, ord: Column) -> DataFrame:
    """One row per term: ``term``, ``first`` (packed position)."""
    base = ord.cast("decimal(20,0)") * F.lit(POSITIONS).cast("decimal(11,0)")
    exploded = posts.select(base.alias("__base"), F.posexplode(terms).alias("__pos", "term"))
    return exploded.select(
        "term",
        (F.col("__base") + F.col("__pos").cast("decimal(10,0)")).cast("decimal(38,0)").alias("first"),
    )


def term_counts(exploded: DataFrame) -> DataFrame:
    """``term, n, first``: occurrences and first position of every term."""
    return exploded.groupBy("term").agg(F.count("*").alias("n"), F.min("first").alias("first"))


def top_terms(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms, earlier first among equals."""
    return counts.orderBy(F.desc("n"), F.asc("first")).limit(k)


def with_rank(top: DataFrame) -> DataFrame:
    """Number an already cut list from 1; the input must be small (a top-k)."""
    packed = top.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "term", "n"))
        ).alias("rows")
    )
    return packed.select(F.posexplode("rows").alias("__i", "row")).select(
        (F.col("__i") + 1).alias("rank"), "row.term", "row.n", "row.first"
    )
