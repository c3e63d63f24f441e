"""Sentiment of each post: by lexicon (native) or by a caller's model (Arrow)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepost.functions.charclass import WORD
from tidepost.functions.fixed_values import NEGATIVE_TERMS, POSITIVE_TERMS
from tidepost.functions.text import model_input, model_label, strip, text_column
from tidepost.operators.grams import FEW, with_found_terms

def term_hits(text: Column, terms: Sequence[str], whole_word: bool = False) -> Column:
    """How many distinct terms occur in the text, in any case."""
    lowered = F.lower(text)
    distinct = dict.fromkeys(t.lower() for t in terms if t)

    def present(term: str) -> Column:
        if whole_word:
            quoted = F.lit(f"(?<![{WORD}])\\Q{term}\\E(?![{WORD}])")
            return F.regexp_like(lowered, quoted)
        return lowered.contains(term)

    # added pair by pair: the depth of the expression stays logarithmic
    hits = [present(t).cast("int") for t in distinct] or [F.lit(0)]
    while len(hits) > 1:
        hits = [reduce(lambda a, b: a + b, hits[i : i + 2]) for i in range(0, len(hits), 2)]
    return hits[0]


def score_hits(positive: Column, negative: Column) -> tuple[Column, Column]:
    """Label and score from two hit counts: the larger side's share, half-even.

    The double itself is rounded, as SQL's ``round_even`` does, not its shortest decimal form as
    by ``bround``: 203 of 400 is a little less than 0.5075.
    """
    larger = F.greatest(positive, negative)
    share = F.rint((larger / F.nullif(positive + negative, F.lit(0))).cast("double") * 1000) / 1000
    tie = positive == negative
    label = F.when(tie, "neutral").when(positive > negative, "positive").otherwise("negative")
    return label, F.when(tie, F.lit(0.5)).otherwise(share)


def with_lexicon_sentiment(
    posts: DataFrame,
    text: Column | None = None,
    positive: Sequence[str] = POSITIVE_TERMS,
    negative: Sequence[str] = NEGATIVE_TERMS,
    whole_word: bool = False,
) -> DataFrame:
    """Add ``sentiment`` and ``sentiment_score``; blank text is neutral 0.5.

    More than ``FEW`` terms on a side are looked up by an index of both sides.
    """
    body = F.coalesce(text if text is not None else text_column(posts.columns), F.lit(""))
    if not whole_word and max(len(positive), len(negative)) > FEW:
        listed = [(t.lower(), side) for side, terms in ((True, positive), (False, negative)) for t in terms if t]
        lexicon = posts.sparkSession.createDataFrame(listed, "term string, positive boolean")
        return with_lexicon_table(posts, lexicon, body, few=0)
    names = ("__positive", "__negative")
    counted = posts.withColumns(
        {
            names[0]: term_hits(body, positive, whole_word),
            names[1]: term_hits(body, negative, whole_word),
        }
    )
    label, score = score_hits(F.col(names[0]), F.col(names[1]))
    return counted.withColumns({"sentiment": label, "sentiment_score": score}).drop(*names)


def with_lexicon_table(posts: DataFrame, lexicon: DataFrame, text: Column | None = None, **sizes: int) -> DataFrame:
    """Add ``sentiment`` and ``sentiment_score`` from a lexicon of any size, a table ``term, positive``.

    Terms count once a text, in any case and inside words too; a term listed on both sides counts
    for both. Blank or null text is neutral 0.5. ``sizes`` goes to ``with_found_terms``.
    """
    body = F.coalesce(text if text is not None else text_column(posts.columns), F.lit(""))
    sides = lexicon.where("positive is not null").select("term", "positive", (~F.col("positive")).alias("negative"))
    # both sides in one look-up, and only their counts
    counted = with_found_terms(posts, body, sides, "__hits", counted=("positive", "negative"), **sizes)
    label, score = score_hits(F.col("__hits.positive"), F.col("__hits.negative"))
    return counted.withColumns({"sentiment": label, "sentiment_score": score}).drop("__hits")


Model = Callable[[list[str]], Sequence[tuple[str, float]]]


def with_model_sentiment(
    posts: DataFrame, load_model: Callable[[], Model], text: Column | None = None
) -> DataFrame:
    """Add ``sentiment``, ``sentiment_score`` and ``sentiment_error`` from a model.

    ``load_model`` runs once per Python worker and gives a function from a list
    of texts to ``(label, score)`` pairs. Blank text never reaches the model. A
    batch that fails is scored text by text, so one bad text marks only itself.
    """
    schema = T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("error", T.StringType()),
        ]
    )

    @F.pandas_udf(schema)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load_model()

        def one(value: str) -> tuple[str | None, float, str | None]:
            try:
                label, score = model([value])[0]
                return label, float(score), None
            except Exception as error:  # the model is foreign code
                return None, 0.5, str(error)

        for batch in batches:
            out = pd.DataFrame(
                {"label": None, "score": 0.5, "error": None}, index=batch.index, dtype=object
            )
            known = batch[batch.notna()]
            try:
                rows = [(label, float(score), None) for label, score in model(known.tolist())]
            except Exception:
                rows = [one(value) for value in known]
            if len(known):
                out.loc[known.index, ["label", "score", "error"]] = pd.DataFrame(
                    rows, index=known.index, columns=["label", "score", "error"], dtype=object
                )
            yield out.astype({"score": "float64"})

    body = text if text is not None else text_column(posts.columns)
    result = predict(F.when(strip(body) != "", model_input(body)))
    return (
        posts.withColumn("__result", result)
        .withColumns(
            {
                "sentiment": model_label(F.coalesce("__result.label", F.lit("neutral"))),
                "sentiment_score": F.bround("__result.score", 3),
                "sentiment_error": F.col("__result.error"),
            }
        )
        .drop("__result")
    )
