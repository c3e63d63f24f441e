"""String scalars over post text, all as JVM-side column expressions.

The one exception is :func:`decode_entities`: Spark has no HTML entity decoder,
so rows that contain ``&`` go through an Arrow UDF; other rows pass NULL to it.
"""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepost.functions.charclass import (
    DIGIT,
    HASHTAG_RE,
    MENTION_RE,
    SPACE,
    SPACE_CHARACTERS,
    SPACES_RE,
    URL_RE,
    WORD,
    WORD_RE,
)
from tidepost.functions.fixed_values import (
    KEYWORD_PREFIXES,
    NEGATIVE_LABELS,
    POSITIVE_LABELS,
    TOPIC_STOPWORDS,
)

ASCII_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
ASCII_LOWER = ASCII_UPPER.lower()
ASCII_DIGITS = "0123456789"


def _run(first: int, plain: str) -> tuple[str, str]:
    """A styled alphabet starts at ``first`` and follows the order of ``plain``."""
    return "".join(chr(first + i) for i in range(len(plain))), plain


# Code points where each styled alphabet starts.
BOLD_LETTERS = (_run(0x1D400, ASCII_UPPER), _run(0x1D41A, ASCII_LOWER))
STYLED_CHARACTERS = BOLD_LETTERS + (
    _run(0x1D5D4, ASCII_UPPER),
    _run(0x1D5EE, ASCII_LOWER),
    _run(0x1D7CE, ASCII_DIGITS),
    _run(0x1D7EC, ASCII_DIGITS),
    _run(0xFF21, ASCII_UPPER),
    _run(0xFF41, ASCII_LOWER),
)


def fold_fonts(text: Column, extended: bool = False) -> Column:
    """Mathematical-bold letters become ASCII; ``extended`` adds the other styles."""
    runs = STYLED_CHARACTERS if extended else BOLD_LETTERS
    styled, plain = ("".join(side) for side in zip(*runs))
    # the test is cheaper than a translation that changes nothing
    present = F.regexp_like(text, F.lit("[" + "".join(f"{r[0][0]}-{r[0][-1]}" for r in runs) + "]"))
    return F.when(present, F.translate(text, styled, plain)).otherwise(text)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(text: Column) -> Column:
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL_RE, "")


def remove_mentions(text: Column) -> Column:
    return F.regexp_replace(text, MENTION_RE, "")


def remove_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, HASHTAG_RE, "")


def remove_symbols(text: Column) -> Column:
    """Keep word characters, white space and plain punctuation."""
    return F.regexp_replace(text, f"[^{WORD}{SPACE},.:;!?#\"'-]+", "")


def strip(text: Column) -> Column:
    """Trim every Unicode space; Spark's ``trim`` only knows U+0020."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def squeeze(text: Column) -> Column:
    """One blank for every run of white space, none at the ends, lowered."""
    blanks = F.translate(text, SPACE_CHARACTERS, " " * len(SPACE_CHARACTERS))
    return F.lower(F.trim(F.regexp_replace(blanks, "  +", " ")))


def clean_text(text: Column, entities: bool = True, extended_fonts: bool = False) -> Column:
    """Normalised text; NULL and empty give ``""``."""
    folded = fold_fonts(text, extended_fonts)
    decoded = decode_entities(folded) if entities else folded
    plain = remove_symbols(remove_mentions(remove_urls(decoded)))
    return F.coalesce(squeeze(plain), F.lit(""))


def hashtags(text: Column, lower: bool = False) -> Column:
    source = F.lower(text) if lower else text
    return F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(HASHTAG_RE), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_RE), F.lit(0)
    )


def topic_tokens(text: Column, stopwords: Sequence[str] = TOPIC_STOPWORDS) -> Column:
    """Lowered words without links, mentions, hashtags, stopwords and short words."""
    plain = F.regexp_replace(remove_urls(F.lower(text)), f"[@#][{WORD}]+", "")
    long_words = F.regexp_extract_all(plain, F.lit(f"[{WORD}]{{3,}}"), F.lit(0))
    kept = F.filter(long_words, lambda w: ~w.isin(*stopwords))
    return F.coalesce(kept, F.array().cast("array<string>"))


def parse_count(label: Column, decimal_point: bool = False) -> Column:
    """Count shown in a label such as ``"1,234 likes"`` or ``"3K"``; 0 if unreadable.

    ``.`` is dropped like ``,`` (so ``1.2K`` reads 12000) unless
    ``decimal_point`` asks for 1200.
    """
    first = F.split(strip(label), SPACES_RE, 2)[0]
    digits = F.regexp_replace(first, "[,.]", "")
    is_kilo, is_mega = digits.contains("K"), digits.contains("M")
    source = F.regexp_replace(first, ",", "") if decimal_point else digits
    bare = (
        F.when(is_kilo, F.replace(source, F.lit("K"), F.lit("")))
        .when(is_mega, F.replace(source, F.lit("M"), F.lit("")))
        .otherwise(digits)
    )
    scale = F.when(is_kilo, F.lit(1000)).when(is_mega, F.lit(1000000)).otherwise(F.lit(1))
    number = F.replace(bare, F.lit("_"), F.lit("")).try_cast("decimal(24,6)")
    value = F.floor(number * scale).try_cast("bigint")
    readable = F.regexp_like(bare, F.lit(r"^[+-]?[0-9]+(_[0-9]+)*([.][0-9]+)?$"))
    return F.coalesce(F.when(readable, value), F.lit(0).cast("bigint"))


def with_fallback_counts(
    counts: Sequence[Column], positional_labels: Column, decimal_point: bool = False
) -> list[Column]:
    """Three counts; if all are 0 and the positional list has four, read them there."""
    total = counts[0] + counts[1] + counts[2]
    use_list = (total == 0) & (F.size(positional_labels) >= 4)
    return [
        F.when(use_list, parse_count(F.get(positional_labels, F.lit(i)), decimal_point))
        .otherwise(count)
        .alias(name)
        for i, (count, name) in enumerate(zip(counts, ("replies", "retweets", "likes")))
    ]


def username_of(profile_url: Column) -> Column:
    return F.substring_index(profile_url, "/", -1)


def permalink_of(link: Column, username: Column, base: str) -> Column:
    return F.coalesce(link, F.concat(F.lit(base), username))


def search_row_text(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", title, body)


def split_keywords(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), strip), lambda k: k != "")


def join_keywords(keywords: Column) -> Column:
    return F.array_join(keywords, " OR ")


def hashtag_form(keyword: Column) -> Column:
    """``#`` plus the keyword without blanks; NULL when it is a hashtag already."""
    return F.when(
        ~keyword.startswith("#"),
        F.concat(F.lit("#"), F.replace(keyword, F.lit(" "), F.lit(""))),
    )


def prefixed_forms(keyword: Column, prefixes: Sequence[str] = KEYWORD_PREFIXES) -> Column:
    """``<prefix> keyword`` for untagged keywords of at most two words, else empty."""
    count = F.size(F.filter(F.split(keyword, SPACES_RE), lambda w: w != ""))
    forms = F.array(*[F.concat(F.lit(p + " "), keyword) for p in prefixes])
    return F.when(~keyword.startswith("#") & (count <= 2), forms).otherwise(
        F.array().cast("array<string>")
    )


def filter_words(variation: Column) -> Column:
    """Words of a variation that a post must contain one of."""
    return F.filter(
        F.split(variation, SPACES_RE),
        lambda w: (F.length(w) > 2) & ~F.regexp_like(w, F.lit(f"^[{DIGIT}]+$")),
    )


def form_encode(keyword: Column) -> Column:
    encoded = F.url_encode(keyword)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def job_keyword(label: Column, decorations: Sequence[str]) -> Column:
    """Keyword of a job for comparison: display decorations removed, lowered."""
    plain = label
    for decoration in decorations:
        plain = F.replace(plain, F.lit(decoration), F.lit(""))
    return F.lower(plain)


def model_label(label: Column) -> Column:
    lowered = F.lower(label)
    return (
        F.when(lowered.isin(*POSITIVE_LABELS), "positive")
        .when(lowered.isin(*NEGATIVE_LABELS), "negative")
        .otherwise("neutral")
    )


def model_input(text: Column, characters: int = 512) -> Column:
    return F.substring(text, 1, characters)


def text_column(columns: Sequence[str], first: str = "text", second: str = "original_text") -> Column:
    """The first column if the table has it (even when empty), else the second."""
    for name in (first, second):
        if name in columns:
            return F.col(name)
    return F.lit("")
