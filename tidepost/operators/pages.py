"""Records, links, markers and outcome of saved pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.functions import fixed_values as V
from tidepost.functions.text import (
    clean_text,
    hashtags,
    parse_count,
    permalink_of,
    search_row_text,
    username_of,
    with_fallback_counts,
)
from tidepost.operators.markup import Element, read_page

LINK_RE = r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'


def page_links(pages: DataFrame, page_id: str, html: str = "html") -> DataFrame:
    """``page_id, pos, link`` for every link of a page, without parsing the page."""
    found = F.regexp_extract_all(F.col(html), F.lit(LINK_RE), F.lit(1))
    return pages.select(page_id, F.posexplode(found).alias("pos", "link"))


def markers_found(html: Column, markers: Sequence[str] = V.BLOCK_MARKERS) -> Column:
    """Markers that occur in the page in any case, in list order."""
    lowered = F.lower(html)
    hits = [F.when(lowered.contains(m.lower()), F.lit(m)) for m in markers]
    return F.array_compact(F.array(*hits))


def probes_found(html: Column, probes: Sequence[tuple[str, bool]] = V.PAGE_PROBES) -> Column:
    hits = [
        F.when((F.lower(html) if any_case else html).contains(p), F.lit(p)) for p, any_case in probes
    ]
    return F.array_compact(F.array(*hits))


def page_report(
    pages: DataFrame,
    page_id: str,
    html: str = "html",
    preview: int = 500,
    markers: Sequence[str] = V.BLOCK_MARKERS,
    probes: Sequence[tuple[str, bool]] = V.PAGE_PROBES,
) -> DataFrame:
    """Size, preview, probes and block markers of each page."""
    body = F.col(html)
    return pages.select(
        page_id,
        F.octet_length(body).alias("size"),
        F.substring(body, 1, preview).alias("preview"),
        probes_found(body, probes).alias("probes"),
        markers_found(body, markers).alias("markers"),
    ).withColumn("blocked", F.size("markers") > 0)


def page_outcome(
    url: Column, html: Column, record_mark: str, empty_text: str = V.EMPTY_RESULT_TEXT
) -> Column:
    """``login``, ``home``, ``results``, ``no_results`` or ``unknown``."""
    where = F.lower(url)
    return (
        F.when(where.contains("login"), "login")
        .when(where.contains("home") & ~where.contains("search"), "home")
        .when(html.contains(record_mark), "results")
        .when(html.contains(empty_text), "no_results")
        .otherwise("unknown")
    )


def search_records(
    pages: DataFrame,
    page_id: str,
    html: str = "html",
    containers: Sequence[str] = V.RESULT_CONTAINERS,
    title: str = "h3",
    link: str = "a",
    keep_rejected: bool = False,
) -> DataFrame:
    """``page_id, pos, title, body, url``: records of the result containers.

    ``pos`` counts containers in selector order, then page order. Records
    without a title or a link are dropped; ``keep_rejected`` gives those instead.
    """
    columns = ["pos", "title", "body", "url"]

    def records(page: Element) -> list[tuple]:
        boxes = [box for selector in containers for box in page.find_all(selector)]
        rows = []
        for pos, box in enumerate(boxes):
            heading, anchor = box.find(title), box.find(link)
            rows.append(
                (
                    pos,
                    heading.text() if heading else None,
                    box.text(),
                    anchor.attrs.get("href") if anchor else None,
                )
            )
        return rows

    found = _parsed(pages, page_id, html, records, columns, "pos int, title string, body string, url string")
    complete = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    return found.where(~complete if keep_rejected else complete)


def search_rows(records: DataFrame, fetched_at: Column, source: str = "google") -> DataFrame:
    """Extracted records as rows of the second source."""
    return records.select(
        search_row_text(F.col("title"), F.col("body")).alias("text"),
        "url",
        F.lit(source).alias("source"),
        F.date_format(fetched_at, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )


def post_cards(pages: DataFrame, page_id: str, html: str = "html") -> DataFrame:
    """Raw parts of every post card: text, profile, time, permalink and labels.

    A card without text, profile or time cannot be read as a post; its missing
    parts are NULL here and :func:`posts_from_cards` drops it.
    """

    def label(card: Element, selector: str) -> str | None:
        button = card.find(selector)
        return button.attrs.get("aria-label") if button else None

    def records(page: Element) -> list[tuple]:
        rows = []
        for pos, card in enumerate(page.find_all(V.POST_CARD)):
            body, user, time = card.find(V.POST_TEXT), card.find(V.POST_USER), card.find("time")
            group = card.find(V.POST_BUTTON_GROUP)
            buttons = group.find_all("button") if group else []
            rows.append(
                (
                    pos,
                    body.text() if body else None,
                    user.attrs.get("href") if user else None,
                    time.attrs.get("datetime") if time else None,
                    time.parent.attrs.get("href") if time else None,
                    *[label(card, selector) for selector in V.POST_BUTTONS],
                    [b.attrs.get("aria-label") for b in buttons],
                )
            )
        return rows

    columns = [
        "pos", "text", "profile", "datetime", "permalink",
        "reply_label", "retweet_label", "like_label", "group_labels",
    ]
    schema = (
        "pos int, text string, profile string, datetime string, permalink string, "
        "reply_label string, retweet_label string, like_label string, group_labels array<string>"
    )
    return _parsed(pages, page_id, html, records, columns, schema)


def posts_from_cards(cards: DataFrame, scraped_at: Column, base: str = V.PROFILE_BASE) -> DataFrame:
    """Readable cards as posts, in the columns of the post table."""
    username = username_of(F.col("profile"))
    readable = F.col("text").isNotNull() & F.col("profile").isNotNull() & F.col("datetime").isNotNull()
    counts = [parse_count(F.col(c)) for c in ("reply_label", "retweet_label", "like_label")]
    return cards.where(readable).select(
        username.alias("username"),
        "text",
        clean_text(F.col("text")).alias("text_clean"),
        hashtags(F.col("text")).alias("hashtags"),
        F.try_to_timestamp("datetime").alias("timestamp"),
        permalink_of(F.col("permalink"), username, base).alias("url"),
        *with_fallback_counts(counts, F.coalesce("group_labels", F.array().cast("array<string>"))),
        scraped_at.alias("scraped_at"),
    )


def _parsed(pages, page_id, html, records, columns, schema) -> DataFrame:
    """Run ``records`` over each page in Arrow batches, giving many rows per page."""
    id_type = pages.schema[page_id].dataType.simpleString()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, *row)
                for key, page in zip(batch[page_id], batch[html])
                for row in records(read_page(page))
            ]
            yield pd.DataFrame(rows, columns=[page_id, *columns])

    return pages.select(page_id, html).mapInPandas(extract, f"{page_id} {id_type}, {schema}")
