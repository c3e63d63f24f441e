"""Keyword expansion from the hashtags and context words of a sample of posts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepost.functions.charclass import WORD_RE
from tidepost.functions.fixed_values import CONTEXT_STOPWORDS
from tidepost.functions.predicates import is_context_word, is_related_tag
from tidepost.functions.text import hashtag_form, hashtags, prefixed_forms, words
from tidepost.operators.dedup import keep_first
from tidepost.operators.ranking import explode_terms, term_counts, top_terms, with_rank


def tag_counts(posts: DataFrame, ord: str, text: str = "text") -> DataFrame:
    return term_counts(explode_terms(posts, hashtags(F.col(text), lower=True), F.col(ord)))


def context_word_counts(
    posts: DataFrame,
    ord: str,
    base_keyword: str,
    text: str = "text",
    stopwords: Sequence[str] = CONTEXT_STOPWORDS,
) -> DataFrame:
    tokens = explode_terms(posts, words(F.col(text)), F.col(ord))
    return term_counts(tokens.where(is_context_word(F.col("term"), base_keyword, stopwords)))


def tag_and_word_counts(
    posts: DataFrame,
    ord: str,
    base_keyword: str,
    text: str = "text",
    stopwords: Sequence[str] = CONTEXT_STOPWORDS,
) -> tuple[DataFrame, DataFrame]:
    """Both counts from one read of the posts and one shuffle.

    Words are counted with the ``#`` in front of them, if any; a tagged word is
    a hashtag and also, without its mark, one more occurrence of the word.
    """
    marked = F.regexp_extract_all(
        F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("#?" + WORD_RE), F.lit(0)
    )
    tagged = F.col("term").startswith("#")
    tokens = explode_terms(posts, marked, F.col(ord))
    counts = term_counts(
        tokens.where(tagged | is_context_word(F.col("term"), base_keyword, stopwords))
    )
    # both readings of a counted term leave one generator, so that no filter on
    # them moves below it and the two results share everything up to here
    readings = F.filter(
        F.array(
            F.struct(F.lit(True).alias("tag"), F.col("term").alias("term")),
            F.struct(F.lit(False).alias("tag"), F.regexp_replace("term", "^#", "").alias("term")),
        ),
        lambda r: F.when(r["tag"], r["term"].startswith("#")).otherwise(
            is_context_word(r["term"], base_keyword, stopwords)
        ),
    )
    read = counts.select(F.explode(readings).alias("r"), "n", "first").select("r.*", "n", "first")
    words_only = (
        read.where(~F.col("tag"))
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )
    return read.where("tag").select("term", "n", "first"), words_only


def smart_query(posts: DataFrame, ord: str, keyword: str, tags: int = 10) -> DataFrame:
    """One row ``query``: the keyword and its top hashtags joined by OR."""
    ranked = with_rank(top_terms(tag_counts(posts, ord), tags))
    joined = ranked.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"]),
            " OR ",
        ).alias("tags")
    )
    return joined.select(F.concat_ws(" OR ", F.lit(keyword), F.nullif("tags", F.lit(""))).alias("query"))


def base_words(keywords: Sequence[str]) -> list[str]:
    """Distinct words of the keywords, lowered, in order."""
    return list(dict.fromkeys(w for k in keywords for w in re.findall(r"\w+", k.lower())))


def _base_variations(
    posts: DataFrame, keywords: Sequence[str], prefixes: Sequence[str]
) -> DataFrame:
    """Rows ``(kind 0, rank, variation)`` from the keywords alone."""
    forms: list[Column] = []
    for keyword in keywords:
        literal = F.lit(keyword)
        forms.append(F.array(literal, hashtag_form(literal)))
        if prefixes:
            forms.append(prefixed_forms(literal, prefixes))
    listed = F.filter(F.flatten(F.array(*forms)), lambda v: v.isNotNull())
    one_row = posts.sparkSession.range(1)
    return one_row.select(F.posexplode(listed).alias("rank", "variation")).select(
        F.lit(0).alias("kind"), F.col("rank").cast("int"), "variation"
    )


def expand_keywords(
    posts: DataFrame,
    ord: str,
    keywords: Sequence[str],
    context: int = 20,
    tags: int = 30,
    min_tag_count: int = 2,
    limit: int = 60,
    related_only: bool = False,
    prefixes: Sequence[str] = (),
    stopwords: Sequence[str] = CONTEXT_STOPWORDS,
) -> DataFrame:
    """Variations of the keywords: ``variation_idx, kind, rank, variation``.

    Kinds in order: the keywords and their hashtag forms (0), keyword plus
    context word (1), hashtags seen at least ``min_tag_count`` times (2). Equal
    variations keep their first place, a tag is dropped if any earlier variation
    equals it in lower case, and the list is cut at ``limit``.
    ``related_only`` and ``prefixes`` give the narrower, older expansion.
    """
    base = " OR ".join(keywords)
    parts = _base_variations(posts, keywords, prefixes)
    if context:
        tag_table, word_table = tag_and_word_counts(posts, ord, base, stopwords=stopwords)
        top_words = with_rank(top_terms(word_table, context))
        parts = parts.unionByName(
            top_words.select(
                F.lit(1).alias("kind"),
                "rank",
                F.concat(F.lit(base + " "), "term").alias("variation"),
            )
        )
    else:
        tag_table = tag_counts(posts, ord)
    # the count threshold applies after the cut to the most frequent tags
    top_tags = with_rank(top_terms(tag_table, tags)).where(
        F.col("n") >= min_tag_count
    )
    if related_only:
        top_tags = top_tags.where(is_related_tag(F.col("term"), base_words(keywords)))
    parts = parts.unionByName(
        top_tags.select(F.lit(2).alias("kind"), "rank", F.col("term").alias("variation"))
    )
    # a lowered tag meets other kinds in lower case, they meet each other exactly
    first_of_tag = F.min(F.struct("kind", "rank")).over(
        Window.partitionBy(F.lower("variation"))
    )
    unique = keep_first(parts, [F.col("variation")], ["kind", "rank"])
    kept = unique.withColumn("__first", first_of_tag).where(
        (F.col("kind") < 2) | (F.col("__first") == F.struct("kind", "rank"))
    )
    cut = kept.orderBy("kind", "rank").limit(limit)
    listed = cut.agg(
        F.array_sort(F.collect_list(F.struct("kind", "rank", "variation"))).alias("rows")
    )
    return listed.select(F.posexplode("rows").alias("variation_idx", "row")).select(
        "variation_idx", "row.kind", "row.rank", "row.variation"
    )
