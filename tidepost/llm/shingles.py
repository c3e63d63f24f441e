"""Words and word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
#: Bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
RUN_CHARS = 1 << 20


def runs(texts: list[str | None], chars: int = RUN_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first position, texts) of runs of about ``chars`` characters."""
    start, held = 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text or "")
        if held >= chars or end == len(texts):
            yield start, texts[start:end]
            start, held = end, 0


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MULTIPLY
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(np.full(n - 1, BASE), out=out[1:]) if n > 1 else None
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts in order, words per text, and byte places of words.

    Words are runs of ASCII letters and digits and of characters beyond ASCII.
    """
    coded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
    inside = IN_WORD[flat]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    text_ends = np.cumsum([len(c) + 1 for c in coded])
    per_text = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), per_text, starts
    lengths = ends - starts
    places = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(places)) - np.repeat(first, lengths)
    terms = (flat[places].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[within]
    return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), per_text, starts


def shingle_hashes(words: np.ndarray, per_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words within each text, their number per text, and the first word of each.

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    n = len(words)
    counts = np.where(per_text >= width, per_text - width + 1, np.minimum(per_text, 1))
    first_word = np.cumsum(per_text) - per_text
    starts = np.repeat(first_word - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    room = np.repeat(np.minimum(per_text, width), counts)
    out = np.zeros(len(starts), dtype=np.uint64)
    for i in range(width):
        word = words[np.minimum(starts + i, max(n - 1, 0))] if n else words
        # Texts shorter than the width end early.
        step = mixed(out ^ (word + np.uint64(i + 1) * BASE))
        out = np.where(room > i, step, out)
    return out, counts, starts
