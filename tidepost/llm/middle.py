"""Fill-in-middle texts: two cuts at unit boundaries, found by ranks over character classes.

Each code point gets a class (its kind, and whether it is the first of a run of its kind).
A wavelet matrix over the classes of a run of texts answers how many units end up to a
place as a sum of ranks, and bisection on these ranks finds the place of a cut. Only the
three numbers of a text leave Python; Spark's expressions draw, cut and join the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.llm.common import lean, text_of
from tidepost.llm.shingles import runs
from tidepost.llm.wavelet import WaveletMatrix

WORD, BLANK, LINE_END, SIGN = range(4)
ALL = tuple(range(8))
#: unit -> (classes that make a boundary, 1 if it lies behind them and 0 if before). A class is 2 * kind + (first of its run).
UNITS = {
    "char": (ALL, 1),
    "word": ((2 * WORD + 1, 2 * SIGN + 1), 0),
    "line": ((2 * LINE_END, 2 * LINE_END + 1), 1),
}
SENTINELS = ("<P>", "<S>", "<M>")


def _ascii_kinds() -> np.ndarray:
    out = np.full(128, SIGN, dtype=np.uint8)
    out[[*range(48, 58), *range(65, 91), *range(97, 123)]] = WORD
    out[[9, 11, 12, 13, 32]] = BLANK
    out[10] = LINE_END
    return out


ASCII = _ascii_kinds()


def classes_of(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of code points; ``first``: where texts start. Beyond ASCII, letters, digits and marks are words."""
    kinds = np.full(len(codes), SIGN, dtype=np.uint8)
    plain = codes < 128
    kinds[plain] = ASCII[codes[plain]]
    rare, at = np.unique(codes[~plain], return_inverse=True)
    own = [chr(c) for c in rare]
    kinds[~plain] = np.array([WORD if c.isalnum() else BLANK if c.isspace() else SIGN for c in own], dtype=np.uint8)[at] if own else 0
    starts = np.ones(len(codes), dtype=np.uint8)
    starts[1:] = kinds[1:] != kinds[:-1]
    starts[first[first < len(codes)]] = 1
    return 2 * kinds + starts


def cuts(texts: list[str], draws: list[tuple[int, ...]] | np.ndarray, unit: str = "char") -> np.ndarray:
    """Per text: its units n, and the places (code points) of the smaller and the larger of its two draws, each taken % (n + 1)."""
    symbols, behind = UNITS[unit]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    matrix = WaveletMatrix(classes_of(codes, begins))
    before = matrix.count(symbols, begins)
    marks = matrix.count(symbols, ends) - before
    if unit == "line":  # a last line without a line end is a unit too
        last = np.maximum(ends - 1, 0)
        open_end = (sizes > 0) & (marks == matrix.count(symbols, last) - before)
        units = marks + open_end
    else:
        units = np.where(sizes > 0, np.maximum(marks, 1), 0)
    drawn = np.asarray(draws, dtype=np.int64).reshape(len(texts), 2) % (units + 1)[:, None]
    out = [units]
    for wanted in (drawn.min(axis=1), drawn.max(axis=1)):
        inner = (wanted > 0) & (wanted < units)
        # A boundary before a unit belongs to unit number wanted + 1; one behind to number wanted.
        number = np.where(inner, before + wanted + (0 if behind else 1), before + marks)
        place = matrix.select(symbols, number, begins, np.where(inner, ends, begins)) - begins - (0 if behind else 1)
        out.append(np.where(inner, place, np.where(wanted > 0, sizes, 0)))
    return np.stack(out, axis=1)


def with_cuts(docs: DataFrame, name: str, text: Column, draws: tuple[Column, Column], unit: str = "char") -> DataFrame:
    """``docs`` and a column ``name`` of (n, first, second): units of the text and the two places it is cut at."""

    @F.pandas_udf("n long, first long, second long")
    @lean
    def find(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, one, two in batches:
            drawn = np.stack([one.to_numpy(dtype=np.int64), two.to_numpy(dtype=np.int64)], axis=1).reshape(-1, 2)
            parts = [cuts(run, drawn[at : at + len(run)], unit) for at, run in runs(texts.tolist())]
            yield pd.DataFrame(np.concatenate([np.zeros((0, 3), dtype=np.int64), *parts]), columns=["n", "first", "second"])

    return docs.withColumn(name, find(text, *draws))


def drawn(id_col: str, seed: str) -> list[Column]:
    """Four whole numbers below 2 ** 32 from the sha256 of ``seed`` and the id (null ids: ``seed`` alone)."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "char",
    percent: int = 90,
    spm_percent: int = 20,
    seed: str = "1:",
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One row per document: doc_id, text, n, form, prefix_chars, middle_chars, output.

    ``n`` counts units: code points, words (a run of letters and digits or of signs with the
    blanks behind it; leading blanks go with the first) or lines. The draws of an id fix its
    two cuts and its form: ``plain`` if the text is empty, holds a sentinel or is not among the
    ``percent`` drawn, else ``spm`` (suffix, prefix, middle) for ``spm_percent`` of the rest and
    ``psm`` (prefix, suffix, middle). Null text counts as empty; plain rows have null
    prefix_chars and middle_chars. Repeated rows come back one for one and alike; an empty
    table gives no rows.
    """
    prefix_sign, suffix_sign, middle_sign = sentinels
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    one, two, share, order = drawn("doc_id", seed)
    found = with_cuts(slim, "cut", F.col("text"), (one, two), unit)
    text, first, second = F.col("text"), F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    held = F.lit(False)
    for sign in sentinels:
        held = held | F.contains(text, F.lit(sign))
    plain = (text == "") | held | (share % 100 >= percent)
    form = F.when(plain, "plain").when(order % 100 < spm_percent, "spm").otherwise("psm")
    prefix = F.substring(text, F.lit(1), first)
    middle = F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.length(text))
    return found.withColumn("form", form).select(
        "doc_id",
        "text",
        F.col("cut.n").alias("n"),
        "form",
        F.when(F.col("form") != "plain", F.col("cut.first")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "spm", F.concat(F.lit(suffix_sign), suffix, F.lit(prefix_sign), prefix, F.lit(middle_sign), middle))
        .otherwise(F.concat(F.lit(prefix_sign), prefix, F.lit(suffix_sign), suffix, F.lit(middle_sign), middle))
        .alias("output"),
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from its output and form."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part(1), part(3), part(2)))
        .otherwise(F.concat(part(2), part(3), part(1)))
    )
