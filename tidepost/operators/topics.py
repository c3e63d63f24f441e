"""Topics of a table of posts: by word frequency, or by LDA over TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.functions.fixed_values import TOPIC_STOPWORDS
from tidepost.functions.text import text_column, topic_tokens
from tidepost.operators.lda import variational_topics
from tidepost.operators.ranking import explode_terms, term_counts, top_terms, with_rank
from tidepost.operators.vectors import term_statistics, tfidf_vectors, vocabulary as kept_terms
from tidepost.session import through_table

TOPIC_SCHEMA = "id int, words array<string>, weight double"


def topic_documents(
    posts: DataFrame, ord: str, stopwords: Sequence[str] = TOPIC_STOPWORDS
) -> DataFrame:
    """``ord, tokens`` of the posts that keep at least one word."""
    tokens = topic_tokens(text_column(posts.columns), stopwords)
    # a filter on the tokens would be pushed down and tokenise every text twice
    kept = F.filter(F.array(tokens), lambda t: F.size(t) > 0)
    return posts.select(F.col(ord).alias("ord"), F.explode(kept).alias("tokens"))


def frequency_topics(
    posts: DataFrame,
    ord: str,
    topics: int = 5,
    words_per_topic: int = 10,
    stopwords: Sequence[str] = TOPIC_STOPWORDS,
) -> DataFrame:
    """The most frequent words cut into ``topics`` groups: ``id, words, weight``."""
    tokens = topic_tokens(text_column(posts.columns), stopwords)
    counts = term_counts(explode_terms(posts, tokens, F.col(ord)))
    ranked = with_rank(top_terms(counts, topics * words_per_topic))
    group = F.floor((F.col("rank") - 1) / words_per_topic).cast("int") + 1
    return (
        ranked.groupBy(group.alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("__words"))
        .select(
            "id",
            F.transform("__words", lambda w: w["term"]).alias("words"),
            (F.size("__words") / words_per_topic).alias("weight"),
        )
    )


def lda_topics(
    posts: DataFrame,
    ord: str,
    topics: int = 5,
    words_per_topic: int = 10,
    vocabulary: int = 1000,
    min_docs: int = 2,
    max_share: float = 0.95,
    iterations: int = 10,
    seed: int = 42,
    stopwords: Sequence[str] = TOPIC_STOPWORDS,
    steps: int = 100,
    tolerance: float = 1e-3,
) -> DataFrame:
    """LDA topics ``id, words, weight``; frequency topics where LDA has no ground.

    Batch variational Bayes over TF-IDF vectors of unit length (see ``operators.lda``). Weights are
    the sums of the words' unnormalised topic values, words equal in value are in reverse
    alphabetical order. The result depends on the rows only, not on their partitions. The
    words and the vectors are stored once below ``spark.checkpoint.dir``, so a text is tokenised once; only the
    vocabulary and its ``topics x vocabulary`` table reach the driver.
    """
    docs = through_table(topic_documents(posts, ord, stopwords), "topic-words")
    statistics = through_table(term_statistics(docs), "topic-terms")
    terms, idf, count = kept_terms(statistics, vocabulary, min_docs, max_share)
    if count < topics or not terms:
        return frequency_topics(posts, ord, topics, words_per_topic, stopwords)
    vectors = through_table(tfidf_vectors(docs, terms, idf), "topic-vectors")
    found = variational_topics(vectors, terms, topics, iterations, steps, tolerance, seed)
    return _described(posts.sparkSession, terms, found, words_per_topic)


def _described(spark, terms: Sequence[str], found: np.ndarray, words_per_topic: int) -> DataFrame:
    rows = []
    for topic, values in enumerate(found):
        best = np.argsort(values, kind="stable")[::-1][:words_per_topic]
        weight = round(float(values[best].sum()), 2)
        rows.append((topic + 1, [terms[i] for i in best], weight))
    return spark.createDataFrame(rows, TOPIC_SCHEMA)
