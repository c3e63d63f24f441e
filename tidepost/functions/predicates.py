"""Row predicates over posts. Each returns a boolean column that is never NULL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepost.functions.charclass import DIGIT, LATIN, SPACE
from tidepost.functions.fixed_values import BLOCKED_ACCOUNTS, CONTEXT_STOPWORDS
from tidepost.functions.text import remove_mentions, remove_urls, strip

# Code-point blocks counted as non-Latin by the older script filter.
# Digits of the last block are left out: they count as digits before.
OTHER_SCRIPTS = (
    r"\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}"
    r"\x{600}-\x{65f}\x{66a}-\x{6ef}\x{6fa}-\x{6ff}"
)


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _beyond_latin(text: Column) -> Column:
    """Characters past the Latin blocks; usually few, so later passes are short."""
    return F.regexp_replace(text, f"[{LATIN}]+", "")


def _without(text: Column, body: str) -> Column:
    return F.regexp_replace(text, f"[{body}]+", "")


def account_allowed(username: Column, blocked: Sequence[str] = BLOCKED_ACCOUNTS) -> Column:
    return ~_known(F.lower(strip(username)).isin(*blocked))


def mostly_latin(text: Column, threshold: float = 0.8) -> Column:
    """Share of Latin, blank and digit characters above ``threshold``; empty fails."""
    size = F.length(text)
    foreign = F.length(_without(_beyond_latin(text), SPACE + DIGIT))
    return _known((size > 0) & ((size - foreign) / F.nullif(size, F.lit(0)) > threshold))


def few_foreign_letters(text: Column, threshold: float = 0.2) -> Column:
    """Share of listed non-Latin scripts below ``threshold``; other scripts don't count."""

    def judge(beyond: Column) -> Column:
        latin = F.length(text) - F.length(_without(beyond, SPACE + DIGIT))
        foreign = F.length(beyond) - F.length(_without(beyond, OTHER_SCRIPTS))
        counted = latin + foreign
        share = foreign / F.nullif(counted, F.lit(0))
        return (counted == 0) | (share < threshold)

    return _known((F.length(text) > 0) & F.exists(F.array(_beyond_latin(text)), judge))


def long_enough(text: Column, minimum: int = 15) -> Column:
    return _known(F.length(strip(remove_urls(text))) >= minimum)


def _judged(text: Column, judge: Callable[[Column], Column]) -> Column:
    """Apply ``judge`` to the stripped body, computing the body once per row."""
    body = strip(remove_mentions(remove_urls(text)))
    return _known(F.exists(F.array(body), judge))


def enough_letters(text: Column, minimum: int = 15, share: float = 0.4, newlines: int = 5) -> Column:
    """The part of :func:`good_quality` that needs no back-references."""

    def judge(body: Column) -> Column:
        size = F.length(body)
        letters = size - F.length(F.regexp_replace(body, r"\p{L}+", ""))
        breaks = size - F.length(F.replace(body, F.lit("\n"), F.lit("")))
        return (
            (size >= minimum)
            & (breaks <= newlines)
            & (letters / F.nullif(size, F.lit(0)) >= share)
        )

    return _judged(text, judge)


def no_repeats(text: Column) -> Column:
    """No character five times in a row, no pair four times in a row."""
    return _judged(
        text,
        lambda body: ~F.regexp_like(body, F.lit(r"([^\n])\1{4}|([^\n][^\n])\2{3}")),
    )


def good_quality(text: Column, minimum: int = 15, share: float = 0.4, newlines: int = 5) -> Column:
    """Long enough, mostly letters, no repeated character or pair, few line breaks."""
    return enough_letters(text, minimum, share, newlines) & no_repeats(text)


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """Any keyword occurs in any case; no keyword keeps every row."""
    lowered = F.lower(text)
    hit = F.lit(not keywords)
    for keyword in keywords:
        hit = hit | lowered.contains(keyword.lower())
    return _known(hit)


def has_url(url: Column) -> Column:
    return F.coalesce(url, F.lit("")) != ""


def in_range(ts: Column, start: Column | None, end: Column | None) -> Column:
    """``start`` inclusive, ``end`` exclusive; a missing bound is open."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (ts >= start)
    if end is not None:
        keep = keep & (ts < end)
    return _known(keep)


def is_context_word(
    word: Column, base_keyword: str, stopwords: Sequence[str] = CONTEXT_STOPWORDS
) -> Column:
    """Worth adding to a keyword: long, no number, no stopword, not in the keyword."""
    return (
        ~word.isin(*stopwords)
        & (F.length(word) > 3)
        & ~F.regexp_like(word, F.lit(f"^[{DIGIT}]+$"))
        & ~F.contains(F.lit(base_keyword.lower()), word)
    )


def is_related_tag(tag: Column, base_words: Sequence[str]) -> Column:
    """A base word of three letters or more is in the tag, or the tag is in a base word."""
    bare = F.lower(F.replace(tag, F.lit("#"), F.lit("")))
    hit = F.lit(False)
    for word in base_words:
        if len(word) >= 3:
            hit = hit | bare.contains(word)
        hit = hit | F.contains(F.lit(word), bare)
    return _known(hit)
