"""Which of many terms occur in a text, in any case and also inside words: a look-up by hashes.

A term can only stand in a run of characters that terms have, so texts are split at all others
and each distinct run of some megabytes of text is looked at once: its windows are hashed by
whole arrays at the lengths that terms have, longer ones only where a shorter one begins a
term, and what hashes like a term is compared with it. So the work follows the texts' distinct
runs and the hits, not texts times terms. The index of the terms is broadcast if it is small by
its measured bytes; else texts and terms meet in an equi-join by grams, runs of ``GRAM``
characters (shorter terms are their own gram).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.session import through_table

GRAM = 4
FEW = 200
MOST_BYTES = 192 << 20
#: At most so many lengths of terms have their prefixes in the filter of what begins a term.
LEVELS = 16
#: Most bits of that filter, as a power of two.
FILTER_BITS = 26
RUN_CHARS = 1 << 20
#: Texts are split into runs by so many bytes, windows of distinct runs are hashed by so many.
TEXT_BYTES, RUN_BYTES = 1 << 22, 1 << 18
#: About so many (text, term) pairs are held at once.
PAIRS = 1 << 18
STEP = np.uint64(0x9E3779B97F4A7C15)
#: An odd number and its inverse modulo 2 ** 64.
BASE = 0xD1342543DE82EF95
BACK = pow(BASE, -1, 1 << 64)
#: Bytes that a term takes in the index besides its text.
TERM_BYTES = 24


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * STEP
    return h ^ (h >> np.uint64(29))


def gram_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``size`` characters of every text, in order."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    counts = np.maximum(lengths - size + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(counts.sum()) + np.repeat((np.cumsum(lengths) - lengths) - (np.cumsum(counts) - counts), counts)
    h = np.full(len(start), size, dtype=np.uint64)
    for i in range(size):
        h = _mixed(h ^ codes[start + i])
    return owner, h


class _Lists:
    """The terms of each number, read from one Arrow array."""

    def __init__(self, texts: pa.Array):
        self.texts = texts

    def __getitem__(self, number: int) -> list[str]:
        if number >= len(self.texts):
            raise IndexError(number)
        return [self.texts[number].as_py()]


class Windows:
    """Hashes of runs of any length in a row of bytes, each in a few steps."""

    def __init__(self, codes: np.ndarray):
        n = len(codes) + 1
        powers, self.back = (np.cumprod(np.where(np.arange(n) > 0, np.uint64(x), np.uint64(1)), dtype=np.uint64) for x in (BASE, BACK))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])

    def hashes(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        own = (self.sums[starts + sizes] - self.sums[starts]) * self.back[starts]
        return _mixed(own ^ (np.asarray(sizes).astype(np.uint64) * STEP))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (without nulls) in one row, and where each begins and the last ends."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """``texts`` in order by about ``most`` bytes, each text whole."""
    ends, at = _bytes(texts)[1], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """In order; sorts in place, where ``np.unique`` of numpy 2.3 takes many times as long by hashing first."""
    numbers.sort()
    new = np.ones(len(numbers), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=new[1:])
    return numbers[new]


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. below each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class TermIndex:
    """Terms, numbered in order, by the hash of all their bytes; ``hits`` gives each text's terms.

    Works on UTF-8: a term stands in a text where its bytes do. An Arrow array has each term
    once and in order; a list may have them in any way.
    """

    def __init__(self, terms: Sequence[str] | pa.Array):
        texts = terms if isinstance(terms, pa.Array) else pa.array(sorted({t for t in terms if t}), pa.string())
        lengths = np.diff(_bytes(texts)[1])
        sizes = np.unique(lengths)
        bits = min(FILTER_BITS, max(10, (8 * len(texts) * min(len(sizes), LEVELS)).bit_length()))
        known, begins = np.zeros(256, bool), np.zeros(1 << bits, bool)
        hashes = [np.zeros(0, np.uint64)]
        for part in _slices(texts, RUN_BYTES):
            data, ends = _bytes(part)
            known[data] = True
            windows, own = Windows(data), np.diff(ends)
            hashes.append(windows.hashes(ends[:-1], own))
            for size in sizes[:LEVELS].tolist():
                begins[(windows.hashes(ends[:-1][own >= size], size) >> np.uint64(64 - bits)).astype(np.int64)] = True
        keys = np.concatenate(hashes)
        number = np.argsort(keys).astype(np.int32)
        # the last key ends every search
        keys, number = np.append(keys[number], ~np.uint64(0)), np.append(number, np.int32(0))
        # where the keys of each value of their first bits begin, and how many keys are equal at most
        buckets = len(keys).bit_length()
        first = np.searchsorted(keys, np.arange(1 << buckets, dtype=np.uint64) << np.uint64(64 - buckets)).astype(np.int32)
        most = int(np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))).max())
        self._hold(texts, sizes.tolist(), keys, number, first, most, known, np.packbits(begins, bitorder="little"))

    def _hold(self, *parts) -> None:
        #: All that the index is made of, to be sent and held again.
        self.parts = parts
        self.texts, self.sizes, self.keys, self.number, self.first, self.most, self.known, self.begins = parts
        self.terms = _Lists(self.texts)
        if len(self.texts):  # read where they are: no copies in a worker
            _, ends, data = self.texts.buffers()
            self.data = np.frombuffer(data, np.uint8)
            self.ends = np.frombuffer(ends, np.int32)[self.texts.offset : self.texts.offset + len(self.texts) + 1]
        self.bits = np.uint64(64 - (8 * len(self.begins)).bit_length() + 1)
        self.shift = np.uint64(64 - len(self.first).bit_length() + 1)

    @classmethod
    def of(cls, parts: tuple) -> TermIndex:
        index = cls.__new__(cls)
        index._hold(*parts)
        return index

    def _may_begin(self, h: np.ndarray) -> np.ndarray:
        slot = h >> self.bits
        return ((self.begins[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Of each hash, the place of the first key that is not less."""
        at = self.first[(h >> self.shift).astype(np.int64)]
        below = np.flatnonzero(self.keys[at] < h)
        while len(below):
            at[below] += 1
            below = below[self.keys[at[below]] < h[below]]
        return at

    def _same(self, data: np.ndarray, start: np.ndarray, number: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` bytes of ``data`` at each start are those of the term."""
        same, step = np.empty(len(start), bool), max(1, RUN_BYTES // size)
        for i in range(0, len(start), step):
            s, n = start[i : i + step, None], self.ends[number[i : i + step], None]
            same[i : i + step] = (data[s + np.arange(size)] == self.data[n + np.arange(size)]).all(axis=1)
        return same

    def _within(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (number of a run, number of a term that occurs in it), in order."""
        data, ends = _bytes(runs)
        owner = np.repeat(np.arange(len(runs)), np.diff(ends))
        live = np.arange(len(data))
        room = ends[1:][owner] - live
        windows, found = Windows(data), [np.zeros(0, np.int64)]
        for level, size in enumerate(self.sizes):
            live = live[room[live] >= size]
            if not len(live):
                break
            h = windows.hashes(live, size)
            if level < LEVELS:
                likely = self._may_begin(h)
                live, h = live[likely], h[likely]
            at = self._places(h)
            for more in range(self.most):
                place = np.minimum(at + more, len(self.keys) - 1)
                real = self.keys[place] == h
                start, number = live[real], self.number[place[real]]
                start, number = (x[self.ends[number + 1] - self.ends[number] == size] for x in (start, number))
                same = self._same(data, start, number, size)
                found.append(owner[start[same]] * len(self.texts) + number[same])
        return np.divmod(_distinct(np.concatenate(found)), max(1, len(self.texts)))

    def _runs_of(self, texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """The runs of bytes that terms have, long enough for a term: text number and bytes."""
        data, ends = _bytes(texts)
        own = self.known[data]
        begin, end = own.copy(), own.copy()
        begin[1:] &= ~own[:-1]
        end[:-1] &= ~own[1:]
        filled = np.flatnonzero(np.diff(ends))
        begin[ends[filled]] = own[ends[filled]]
        end[ends[filled + 1] - 1] = own[ends[filled + 1] - 1]
        starts = np.flatnonzero(begin)
        lengths = np.flatnonzero(end) + 1 - starts
        text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends)))
        places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[own])])
        long = lengths >= min(self.sizes, default=0)
        return text[long], runs.filter(pa.array(long)).dictionary_encode()

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Some texts after the other, none null: how many, and distinct (number of a text of these, number of a term that occurs in it), in order."""
        if not len(texts):
            yield 0, *(np.zeros(0, np.int64),) * 2
        for part in _slices(texts, TEXT_BYTES):
            text, runs = self._runs_of(part)
            held, base = [(np.zeros(0, np.int64),) * 2], 0
            for piece in _slices(runs.dictionary, RUN_BYTES):
                run, number = self._within(piece)
                held.append((base + run, number))
                base += len(piece)
            run, number = map(np.concatenate, zip(*held))
            counts = np.bincount(run, minlength=base)
            offsets = np.cumsum(counts) - counts
            text, run = np.divmod(_distinct(text * max(1, base) + runs.indices.to_numpy(zero_copy_only=False)), max(1, base))
            up_to = np.cumsum(np.bincount(text, weights=counts[run], minlength=len(part)).astype(np.int64)) // PAIRS
            cuts = [0, *(np.flatnonzero(np.diff(up_to)) + 1).tolist(), len(part)]
            for start, end in zip(cuts, cuts[1:]):
                own = slice(*np.searchsorted(text, [start, end]))
                many = counts[run[own]]
                terms = number[np.repeat(offsets[run[own]], many) + _spread(many)]
                pairs = _distinct(np.repeat(text[own] - start, many) * len(self.texts) + terms)
                yield end - start, *np.divmod(pairs, max(1, len(self.texts)))

    def find(self, texts: list[str]) -> list[list[str]]:
        out: list[list[str]] = []
        for size, text, number in self.hits(pa.array(texts, pa.string())):
            found: list[list[str]] = [[] for _ in range(size)]
            for i, k in zip(text.tolist(), number.tolist()):
                found[i] += [t for t in self.terms[k]]
            out += found
        return out


def _runs(texts: list[str]) -> Iterator[list[str]]:
    start, held = 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text)
        if held >= RUN_CHARS or end == len(texts):
            yield texts[start:end]
            start, held = end, 0


def known_terms(terms: DataFrame, column: str = "term", counted: Sequence[str] = ()) -> DataFrame:
    """``term``: distinct, lowered, not empty, and which ``counted`` columns hold for any of its rows; stored once."""
    lowered = terms.select(F.lower(F.col(column)).alias("term"), *counted).where("term <> ''")
    held = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in counted]
    return through_table(lowered.groupBy("term").agg(*held) if held else lowered.distinct(), "terms")


def with_found_terms(
    rows: DataFrame,
    text: Column,
    terms: DataFrame,
    name: str,
    few: int = FEW,
    most_bytes: int = MOST_BYTES,
    counted: Sequence[str] = (),
) -> DataFrame:
    """``rows`` and an array column ``name`` of the distinct terms (lowered, in order) that occur in ``text``.

    ``terms`` has a column ``term``; null and empty ones are left out. A null text holds no
    term. Up to ``few`` terms are tested by generated code; more, up to ``most_bytes`` of
    them, by a broadcast index; any number beyond by a join. All give the same rows. With
    ``counted``, names of boolean columns of ``terms``, ``name`` is a struct that has for each
    of them how many of the terms found it holds for.
    """
    known = known_terms(terms, counted=counted)
    size = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    low = F.coalesce(F.lower(text), F.lit(""))
    if size["n"] <= few:
        lowered = rows.withColumn("__low", low)

        def found(held: list) -> Column:
            hits = [F.when(F.contains("__low", F.lit(w)), F.lit(w)) for w in sorted(r["term"] for r in held)]
            return (F.array_compact(F.array(*hits)) if hits else F.array()).cast("array<string>")

        own = known.collect()
        counts = [F.size(found([r for r in own if r[c]])).alias(c) for c in counted]
        return lowered.withColumn(name, F.struct(*counts) if counts else found(own)).drop("__low")
    if size["bytes"] + TERM_BYTES * size["n"] <= most_bytes:
        return rows.withColumn(name, _by_index(low, known, counted))
    return _by_join(rows, low, known, name, counted)


def _by_index(low: Column, known: DataFrame, counted: Sequence[str]) -> Column:
    held = known.orderBy("term").toArrow()
    marks = [held[c].to_numpy() for c in counted]
    index = TermIndex(held["term"].cast(pa.string()).combine_chunks())
    sent = known.sparkSession.sparkContext.broadcast((index.parts, marks))
    kind = f"struct<{','.join(f'`{c}`:int' for c in counted)}>" if counted else "array<string>"

    def lists(index: TermIndex, texts: pa.Array) -> Iterator[pa.Array]:
        for size, text, number in index.hits(texts):
            ends = np.searchsorted(text, np.arange(size + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), index.texts.take(pa.array(number)))

    def counts(index: TermIndex, texts: pa.Array) -> Iterator[pa.Array]:
        for size, text, number in index.hits(texts):
            found = [np.bincount(text[m[number]], minlength=size).astype(np.int32) for m in sent.value[1]]
            yield pa.StructArray.from_arrays([pa.array(f) for f in found], names=list(counted))

    @F.arrow_udf(kind)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, form = None, counts if counted else lists
        for texts in batches:
            index = index or TermIndex.of(sent.value[0])
            yield pa.concat_arrays(list(form(index, texts.cast(pa.string()))))

    return find(low)


def _by_join(rows: DataFrame, low: Column, known: DataFrame, name: str, counted: Sequence[str]) -> DataFrame:
    """Grams of texts meet terms by hash; a gram is the term's rarest one in these texts."""
    kept = through_table(rows.withColumns({"__low": low, "__uid": F.monotonically_increasing_id()}), "term-rows")
    sizes = sorted(r["s"] for r in known.select(F.least(F.char_length("term"), F.lit(GRAM)).alias("s")).distinct().collect())

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, at = batch["id"].to_numpy(dtype=object), 0
            for run in _runs(batch["text"].tolist()):
                terms = batch["is_term"].iloc[at] if len(batch) else False
                for size in sizes:
                    # a term counts with the grams of its own size only
                    own = [t if min(len(t), GRAM) == size else "" for t in run] if terms else run
                    owner, h = gram_hashes(own, size)
                    yield pd.DataFrame({"id": ids[at + owner], "gram": h.view(np.int64)}).drop_duplicates()
                at += len(run)

    own_grams = through_table(
        known.select(F.col("term").alias("id"), F.col("term").alias("text"), F.lit(True).alias("is_term")).mapInPandas(grams, "id string, gram long"),
        "term-grams",
    )
    wanted = own_grams.select("gram").distinct()
    text_grams = kept.select(F.col("__uid").alias("id"), F.col("__low").alias("text"), F.lit(False).alias("is_term")).mapInPandas(grams, "id long, gram long")
    held = through_table(text_grams.join(wanted, "gram", "left_semi"), "term-text-grams")
    often = held.groupBy("gram").agg(F.count("*").alias("texts"))
    # A term with a gram that no text has occurs nowhere.
    rated = own_grams.join(often, "gram", "left")
    best = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("best")
    chosen = rated.groupBy(F.col("id").alias("term")).agg(best).where("best.texts > 0").select("term", F.col("best.gram").alias("gram"))
    marked = chosen.join(known, "term") if counted else chosen
    terms = F.array_sort(F.collect_list(F.struct("term", *counted))).alias("__terms")
    candidates = held.join(marked, "gram").groupBy(F.col("id").alias("__uid")).agg(terms)
    none = F.array().cast(candidates.schema["__terms"].dataType)
    found = F.filter(F.coalesce("__terms", none), lambda t: F.contains(F.col("__low"), t["term"]))
    counts = [F.size(F.filter(found[c], lambda x: x)).alias(c) for c in counted]
    return (
        kept.join(candidates, "__uid", "left")
        .withColumn(name, F.struct(*counts) if counted else F.transform(found, lambda t: t["term"]))
        .drop("__uid", "__low", "__terms")
    )
