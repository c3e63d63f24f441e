"""Passages that occur elsewhere, by a Lempel-Ziv parse relative to an index of all documents.

Documents are cut into reference blocks at places that their own words choose: the anchor of
a window of ``width`` words is the last of its runs of ``gram`` words with the smallest hash,
and a block spans all neighbouring windows with one anchor. So equal passages are cut alike
wherever they stand, and the index is a table partitioned by anchor: a document meets every
block that shares an anchor with it, and blocks that share none cannot hold a window of its.

The parse is greedy: a block found elsewhere is taken whole, and neighbouring factors join
into one long factor. Only where a factor may end, in blocks whose anchor stands in several
different surroundings, are single windows looked up. Two equal windows have the same anchor;
they lie in equal blocks, or their anchor has different ones, so nothing is missed.

Fingerprints are 64 bits for the anchor and 64 for the block or window. No pairs of places
are ever made: places meet in counts, which combine before the shuffle, and fingerprints
that stand in a thousandth of all places or more (so a thousand at most) are marked map-side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.llm.common import lean, stored
from tidepost.llm.shingles import BASE, MULTIPLY, mixed, runs

WIDTH = 35
GRAM = 12
BLANKS = (9, 10, 11, 12, 13, 32)
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[list(BLANKS)] = False
#: The map-side filter has 16 bits for an anchor, and at most 2 ** FILTER_BITS bits, for each of its two sets.
FILTER_BITS = 26
#: A fingerprint with at least one of this many places is hot, so there are at most this many hot ones.
HOT_SHARE = 1000
WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (unchanged) of all texts in order, and words per text."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
    inside = IN_WORD[flat]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    text_ends = np.cumsum([len(c) + 1 for c in coded])
    per_text = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), per_text
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(lengths.sum()) - np.repeat(first, lengths)
    terms = (flat[inside].astype(np.uint64) + np.uint64(1)) * _powers(BASE, int(lengths.max()))[within]
    return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * MULTIPLY), per_text


class Sums:
    """Fingerprints of runs of words from running sums, whatever their place."""

    def __init__(self, words: np.ndarray, base: np.uint64 = WINDOW_BASE):
        self.total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * _powers(base, len(words)), out=self.total[1:])
        self.back = _powers(_inverse(base), len(words) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64) * MULTIPLY)


def blocks_of(words: np.ndarray, per_text: np.ndarray, width: int, gram: int):
    """Blocks of all texts: first window start, last window start, anchor hash, fingerprint; and the window sums.

    Every start of a window of ``width`` words within a text lies in exactly one block.
    """
    n = len(words)
    sums = Sums(words)
    starts_ok = np.zeros(n + 1, dtype=bool)  # where windows start
    ends = np.cumsum(per_text)
    for_texts = np.maximum(per_text - width + 1, 0)
    begins = ends - per_text
    np.add.at(edge := np.zeros(n + 2, dtype=np.int64), begins[for_texts > 0], 1)
    np.add.at(edge, (begins + for_texts)[for_texts > 0], -1)
    starts_ok[:] = np.cumsum(edge)[: n + 1] > 0
    starts = np.flatnonzero(starts_ok)
    none = np.zeros(0, dtype=np.int64)
    if not len(starts):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), sums
    at = np.arange(n - gram + 1)
    grams = sums.of(at, at + gram)
    steps = width - gram + 1
    bits = np.uint64((1 << int(steps - 1).bit_length()) - 1)
    keys = mixed(grams) & ~bits
    # The smallest hash; among equal ones the last, since later runs carry smaller low bits.
    best = keys[: n - width + 1] | bits
    for j in range(1, steps):
        np.minimum(best, keys[j : j + n - width + 1] | (bits - np.uint64(j)), out=best)
    anchor = starts + (bits - (best[starts] & bits)).astype(np.int64)
    change = np.ones(len(starts), dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(change)
    last = starts[np.append(head[1:], len(starts)) - 1]
    first, anchor = starts[head], anchor[head]
    offset = (anchor - first).astype(np.uint64)
    print_ = mixed(sums.of(first, last + width) ^ (offset * BASE))
    return first, last, grams[anchor], print_, sums


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes of a row's id and text: rows alike in both share them, and get the same result."""
    parts = [doc_id.isNull(), doc_id, text.isNull(), text]
    return [F.xxhash64(F.lit(salt), *parts) for salt in (0, 1)]


def _slot(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(anchor) >> np.uint64(64 - bits)).astype(np.int64)


def _anchor_rows(width: int, gram: int):
    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, run in runs(batch.column(0).to_pylist()):
                words, per_text = word_codes(run)
                _, _, anchor, print_, _ = blocks_of(words, per_text, width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(print_.view(np.int64))], names=["anchor", "print"])

    return emit


def shared_anchors(docs: DataFrame, text_col: str, width: int, gram: int) -> DataFrame:
    """Anchors that stand in several places: anchor, varied (in different blocks)."""
    text = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    found = text.mapInArrow(_anchor_rows(width, gram), "anchor long, print long").groupBy("anchor")
    counted = found.agg(F.count("*").alias("places"), F.min("print").alias("low"), F.max("print").alias("high"))
    return counted.where("places > 1").select("anchor", (F.col("low") != F.col("high")).alias("varied"))


def anchor_filter(anchors: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of slots as bits: of shared anchors, and of varied ones. At most 2 ** bits bits each, whatever the input."""

    @lean
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = _slot(batch["anchor"].to_numpy().view(np.uint64), bits)
            yield pd.DataFrame({"word": slot >> 6, "bit": slot & 63, "varied": batch["varied"]})

    one = F.expr("shiftleft(1L, cast(bit AS int))")
    folded = (
        anchors.mapInPandas(fold, "word long, bit long, varied boolean")
        .groupBy("word")
        .agg(F.bit_or(one).alias("all_bits"), F.bit_or(F.when(F.col("varied"), one).otherwise(0)).alias("varied_bits"))
        .toPandas()
    )
    out = np.zeros((2, 1 << (bits - 6)), dtype=np.int64)
    out[:, folded["word"].to_numpy()] = folded[["all_bits", "varied_bits"]].to_numpy().T
    return out[0].view(np.uint64), out[1].view(np.uint64)


def _has(filter_: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (filter_[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


PLACES = "key_1 long, key_2 long, anchor long, print long, first int, windows int"


def _place_rows(shared, bits: int, width: int, gram: int):
    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, run in runs(batch.column(2).to_pylist()):
                words, per_text = word_codes(run)
                first, last, anchor, print_, sums = blocks_of(words, per_text, width, gram)
                slot = _slot(anchor, bits)
                known, varied = (_has(f, slot) for f in shared.value)
                ends = np.cumsum(per_text)
                # whole blocks, then the windows of blocks with a varied anchor
                sizes = (last - first + 1)[varied]
                start = np.repeat(first[varied] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                window = mixed(sums.of(start, start + width) + MULTIPLY)  # no block has a window's fingerprint
                begin = np.concatenate([first[known], start])
                owner = np.searchsorted(ends, begin, side="right")
                columns = [
                    ones[at + owner],
                    twos[at + owner],
                    np.concatenate([anchor[known], np.repeat(anchor[varied], sizes)]).view(np.int64),
                    np.concatenate([print_[known], window]).view(np.int64),
                    (begin - (ends - per_text)[owner]).astype(np.int32),
                    np.concatenate([(last - first + 1)[known], np.ones(len(start))]).astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in PLACES.split(", ")])

    return emit


def factors(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """key_1, key_2 and parts: (first, windows) of the runs of window starts of a row that also start elsewhere."""
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    anchors = stored(shared_anchors(docs, text_col, width, gram), "substring-anchors")
    bits = min(filter_bits, max(10, (16 * anchors.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(anchor_filter(anchors, bits))
    keys = [k.alias(f"key_{i}") for i, k in enumerate(row_key(doc_id, text), 1)]
    places = stored(docs.select(*keys, text.alias("text")).mapInArrow(_place_rows(shared, bits, width, gram), PLACES), "substring-places")
    total = places.count()
    counted = places.groupBy("anchor", "print").agg(F.count("*").alias("places")).where("places > 1")
    counted = stored(counted, "substring-index")
    often = max(2, -(-total // HOT_SHARE))
    hot = counted.where(F.col("places") >= often).select("anchor", "print")
    rest = counted.where(F.col("places") < often).select("anchor", "print")
    on = ["anchor", "print"]
    marked = places.join(F.broadcast(hot), on, "left_semi").unionByName(
        places.join(F.broadcast(hot), on, "left_anti").join(rest, on, "left_semi")
    )
    part = F.struct("first", "windows")
    return marked.select("key_1", "key_2", part.alias("part")).groupBy("key_1", "key_2").agg(F.collect_set("part").alias("parts"))


def joined(parts, width: int) -> list[tuple[int, int]]:
    """Word spans covered by windows that start in ``parts``: sorted, disjoint, not touching."""
    out: list[tuple[int, int]] = []
    for first, windows in sorted((p["first"], p["windows"]) for p in parts):
        start, end = first, first + windows - 1 + width
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (start, end in words), kept_text.

    Words are what ASCII white space parts, unchanged. A word goes if a window of ``width``
    words that covers it also starts anywhere else, in the same document too; windows are
    those of the input. ``kept_text`` joins the other words by one space. Null text has no
    words; rows that repeat id and text are copies of each other and come back one for one.
    An empty table gives no rows. Beyond ``2 ** filter_bits`` bits the map-side filter only lets
    more places through to the exact counts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    keys = [k.alias(f"key_{i}") for i, k in enumerate(row_key(doc_id, text), 1)]
    slim = docs.select(doc_id.alias("doc_id"), text.alias("text"), *keys)
    known = stored(factors(docs, id_col, text_col, width, gram, filter_bits), "substring-factors")
    # Only texts that may have a factor meet them; the others are never shuffled.
    bits = min(filter_bits, max(10, (16 * known.count()).bit_length()))
    word, bit = F.shiftrightunsigned("key_1", 64 - (bits - 6)), F.shiftrightunsigned("key_1", 64 - bits).bitwiseAND(63).cast("int")
    held = known.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    # At most 2 ** (filter_bits - 6) rows, whatever the input: safe to broadcast.
    marked = slim.withColumn("word", word).join(F.broadcast(held), "word", "left")
    may = F.coalesce(F.getbit("bits", bit) == 1, F.lit(False))
    met = marked.where(may).join(known, ["key_1", "key_2"], "left").select("doc_id", "text", "parts")
    none = F.lit(None).cast(known.schema["parts"].dataType)
    found = met.unionByName(marked.where(~may).select("doc_id", "text", none.alias("parts")))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, run in runs(batch.column(1).to_pylist()):
                own = batch.slice(at, len(run))
                counts, removed, spans, kept = [], [], [], []
                for text, parts in zip(run, own.column(2).to_pylist()):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    gone = joined(parts or [], width)
                    counts.append(len(words))
                    removed.append(sum(b - a for a, b in gone))
                    spans.append([{"start": a, "end": b} for a, b in gone])
                    for a, b in reversed(gone):
                        del words[a:b]
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pair), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
                )

    return found.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")
