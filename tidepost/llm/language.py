"""Language identification by segmentation-marginalised unigrams.

A word's probability in a language is the sum over all ways to cut it into pieces of a
fixed public vocabulary, each way being the product of its pieces' probabilities in that
language. A forward pass over the word adds them all up. The probabilities are fitted by
expectation maximisation: expected uses of each piece, over all segmentations, summed by
Spark over the word counts of the labelled sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.llm.common import lean, stored, text_of
from tidepost.llm.encoders import default_path

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
UNDECIDED = "und"
#: A run of a word cut at ``MAX_WORD`` letters begins with this instead of the word-start sign.
GOES_ON = "\0"
#: Longest pieces taken from the vocabulary (``fit(longest_piece=...)``), and letters of a word scored in one go.
MAX_PIECE = 8
MAX_WORD = 40
UNIT = 1 << 20
#: Forward values are held times this for each letter passed, so that 41 letters stay within a float's range.
LETTER = 2.0**20
#: Words are worked on in blocks of about this many (place, language) cells.
CELLS = 1 << 18
#: Bounds of the memo of chunks: bytes in all, and letters of a chunk that is held beyond its run.
MEMO_BYTES = 24 << 20
MEMO_KEY = 48
RUN_CHARS = 1 << 19
#: The fit works on a bounded sample; this many tasks share it.
FIT_TASKS = 16
#: The baseline that a text must not fall behind: every letter one of so many, all alike.
BASE_LETTERS = 96


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    pieces: list[str]
    #: probability of each piece in each language; then of no piece, and of any other letter
    probs: np.ndarray


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case (with a letter at least).

    Runs over ``MAX_WORD`` letters are scored in several parts; the parts after the first are
    marked, so that they don't count as words of their own.
    """
    found = WORD.findall(text.lower())
    if not text.isascii():  # the pattern also takes number signs such as superscripts
        found = [w for w in found if any(map(str.isalpha, w))]
    if len(text) > MAX_WORD and any(len(w) > MAX_WORD for w in found):
        found = [(GOES_ON if i else "") + w[i : i + MAX_WORD] for w in found for i in range(0, len(w), MAX_WORD)]
    return found


def has_letter(text: Column) -> Column:
    """Whether a text has a letter (false for null), without a model."""
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def vocabulary(path: str, longest: int = MAX_PIECE) -> list[str]:
    """Letter-only pieces of up to ``longest`` characters of a sentencepiece vocabulary, in lower case, with the word-start sign."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        core = piece.removeprefix(START)
        if core and core.isalpha() and core == core.lower() and len(piece) <= longest:
            out.add(piece)
    return sorted(out)


class Lattice:
    """All cuts of many words at once: the piece at each (start, length), by a hashed lookup.

    Piece numbers: 0 up to the vocabulary's size; then "no piece" (probability 0) and
    "letter outside the vocabulary" (the floor).
    """

    SLOTS = 1 << 20
    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.none, self.other = len(pieces), len(pieces) + 1
        self.lengths = np.array([*map(len, pieces), 1, 1])
        self.longest = int(self.lengths.max())
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.held = np.zeros(self.SLOTS, dtype=bool)  # most substrings are no piece and end here
        self.held[self._slots(keys)] = True

    def _key(self, piece: str) -> np.uint64:
        h = np.zeros(1, dtype=np.uint64)
        for letter in piece:
            h = self._add(h, np.array([ord(letter)], dtype=np.uint64))
        return h[0]

    def _add(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code) * self.STEP
        return h ^ (h >> np.uint64(29))

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(40)).astype(np.int64) & (self.SLOTS - 1)

    def arcs(self, codes: np.ndarray) -> dict[tuple[int, int], tuple]:
        """(start, end) -> rows that have a piece there, and its number. ``codes``: words of one length."""
        n, out = codes.shape[1], {}
        columns = np.ascontiguousarray(codes.T)
        everyone = np.arange(len(codes))
        for start in range(n):
            h = np.zeros(len(codes), dtype=np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = self._add(h, columns[end - 1])
                rows = np.flatnonzero(self.held[self._slots(h)])
                at = np.searchsorted(self.keys, h[rows])
                at[at == len(self.keys)] = 0
                real = self.keys[at] == h[rows] if len(rows) else np.zeros(0, dtype=bool)
                rows, number = rows[real], self.order[at[real]]
                if end - start == 1:
                    every = np.full(len(codes), self.other)
                    every[rows] = number
                    out[start, end] = (everyone, every)
                elif len(rows):
                    out[start, end] = (rows, number)
        return out


def _by_length(words: list[str], width: int):
    """Positions and letter codes (with the word-start sign) of blocks of words of one length, of about ``CELLS`` cells."""
    groups: dict[tuple[int, bool], list[int]] = {}
    for at, word in enumerate(words):
        groups.setdefault((len(word), word[:1] == GOES_ON), []).append(at)
    for size, goes_on in sorted(groups):
        every = groups[size, goes_on]
        step = max(1, CELLS // ((size + 2) * width))
        for low in range(0, len(every), step):
            own = every[low : low + step]
            flat = np.frombuffer("".join([words[i] for i in own]).encode("utf-32-le"), dtype="<u4").reshape(-1, size)
            codes = np.empty((len(own), size + 1), dtype=np.uint64)
            codes[:, 0] = ord(START)
            codes[:, 1:] = flat
            yield np.asarray(own), codes[:, 2:] if goes_on else codes


def _scaled(probs: np.ndarray, lattice: Lattice) -> np.ndarray:
    scale = LETTER ** lattice.lengths.astype(float)
    return probs * (scale if probs.ndim == 1 else scale[:, None])


def segment_sums(words: list[str], lattice: Lattice, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations."""
    out = np.empty((len(words), probs.shape[1]))
    scaled = _scaled(probs, lattice)
    for own, codes in _by_length(words, probs.shape[1]):
        alpha = np.zeros((codes.shape[1] + 1, len(own), probs.shape[1]))
        alpha[0] = 1.0
        for (start, end), (rows, number) in sorted(lattice.arcs(codes).items()):
            alpha[end][rows] += alpha[start][rows] * scaled[number]
        out[own] = np.log(alpha[-1]) - codes.shape[1] * np.log(LETTER)
    return out


def expected_uses(words: list[str], counts: np.ndarray, lattice: Lattice, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in one language, in whole units per word."""
    out = np.zeros(len(probs))
    scaled = _scaled(probs, lattice)
    for own, codes in _by_length(words, 1):
        n = codes.shape[1]
        arcs = sorted(lattice.arcs(codes).items())
        alpha, beta = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
        alpha[0] = beta[n] = 1.0
        for (start, end), (rows, number) in arcs:
            alpha[end][rows] += alpha[start][rows] * scaled[number]
        for (start, end), (rows, number) in reversed(arcs):
            beta[start][rows] += scaled[number] * beta[end][rows]
        scale = counts[own] * UNIT / alpha[n]
        for (start, end), (rows, number) in arcs:
            uses = np.rint(alpha[start][rows] * scaled[number] * beta[end][rows] * scale[rows])
            out += np.bincount(number, weights=uses, minlength=len(out))
    return out


def fit(
    docs: DataFrame,
    label: str = "lang",
    text_col: str = "text",
    key: Column | None = None,
    path: str | None = None,
    sample: int = 400,
    rounds: int = 2,
    smoothing: float = 0.1,
    longest_piece: int = MAX_PIECE,
) -> Model:
    """Fit on about ``sample`` distinct labelled texts per language (all, if fewer); null labels are left out.

    ``sample`` bounds the cost of the fit, however often a text is repeated: copies count once.
    The share of each language counts all rows. The sample is by hash of ``key`` (by default the
    text), so reruns agree. Without labelled
    text the model knows no language and every prediction is undecided. Pieces of more than
    ``longest_piece`` characters are left out of the vocabulary; their texts are cut into shorter ones.
    """
    path = path or default_path("piece_bpe_32k.model")
    lang = F.col(f"`{label}`").cast("string")
    known = docs.where(lang.isNotNull())
    counts = {r["l"]: r["n"] for r in known.groupBy(lang.alias("l")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(0), [], np.zeros((2, 0)))
    unit = key if key is not None else F.col(f"`{text_col}`")
    distinct = known.select(lang.alias("l"), F.xxhash64(unit).alias("unit")).distinct().groupBy("l")
    sizes = {r["l"]: r["n"] for r in distinct.agg(F.count("*").alias("n")).collect()}
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))])
    at = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), unit), 11) / F.lit(2.0**53)
    # copies of a chosen text meet under its hash, one for each task that has some
    chosen = (
        known.where(at < shares[lang])
        .select(lang.alias("lang"), text_of(text_col).alias("text"))
        .groupBy("lang", F.xxhash64("text").alias("hash"))
        .agg(F.min("text").alias("text"))
        .select("lang", "text")
    )

    @lean
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: dict[tuple[str, str], int] = {}
            for own, text in zip(batch["lang"], batch["text"]):
                for word in words_of(text):
                    rows[own, word] = rows.get((own, word), 0) + 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in rows.items()], columns=["lang", "word", "n"])

    words = stored(
        chosen.mapInPandas(tally, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(FIT_TASKS),
        "language-words",
    )
    pieces = vocabulary(path, longest_piece)
    probs = np.full((len(pieces) + 2, len(languages)), 1.0 / len(pieces))
    probs[-2:] = [[0.0] * len(languages), [0.1 / len(pieces)] * len(languages)]
    for _ in range(rounds):
        probs = _maximise(words, languages, pieces, probs, smoothing)
    total = sum(counts.values())
    return Model(languages, np.log([counts[k] / total for k in languages]), pieces, probs)


def _maximise(words: DataFrame, languages, pieces, probs, smoothing) -> np.ndarray:
    """One round: expected uses summed by Spark as whole numbers, so that their order cannot matter."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, probs))

    @lean
    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_pieces, own_probs = shared.value
        lattice = None
        for batch in batches:
            lattice = lattice or Lattice(own_pieces)
            for lang, rows in batch.groupby("lang"):
                at = languages.index(lang)
                uses = expected_uses(rows["word"].tolist(), rows["n"].to_numpy(), lattice, own_probs[:, at])
                used = np.flatnonzero(uses)
                yield pd.DataFrame({"lang": at, "piece": used, "uses": uses[used].astype(np.int64)})

    found = words.mapInPandas(expect, "lang int, piece int, uses long")
    # One row per language and piece of the vocabulary.
    uses = np.zeros_like(probs)
    for row in found.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect():
        uses[row["piece"], row["lang"]] = row["uses"] / UNIT
    shared.destroy()
    total = uses.sum(axis=0) + smoothing * (len(pieces) + 1)
    out = (uses + smoothing) / total
    out[-2] = 0.0
    out[-1] /= 1000
    return out


class Scorer:
    """Predictions for batches of texts, with a memo (bounded in bytes) of the chunks between white space met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.lattice = Lattice(model.pieces)
        self._reset(0)

    def _reset(self, least: int) -> None:
        """Forget all chunks; room for ``least`` new ones at least."""
        self.width = len(self.model.languages) + 2
        self.index: dict[str, int] = {}
        self.free = 0
        self.bytes = 0
        self.table = np.zeros((max(least, MEMO_BYTES // (160 + 8 * self.width)), self.width))

    def _learn(self, new: list[str]) -> None:
        """Rows of the table for new chunks: sums over their words, the number of words and of letters."""
        words = [words_of(c) for c in new]
        sizes = np.array([len(w) for w in words])
        distinct = sorted(set().union(*words))
        number = dict(zip(distinct, range(len(distinct))))
        rows = self.table[self.free : self.free + len(new)]
        rows[:] = 0
        if distinct:
            sums = np.empty((len(distinct), self.width))
            sums[:, :-2] = segment_sums(distinct, self.lattice, self.model.probs)
            sums[:, -2] = 1
            sums[:, -1] = [len(w.removeprefix(GOES_ON)) for w in distinct]
            flat = sums[[number[w] for own in words for w in own]]
            filled = np.flatnonzero(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
            rows[filled] = np.add.reduceat(flat, starts, axis=0)
        self.index.update(zip(new, range(self.free, self.free + len(new))))
        self.free += len(new)
        self.bytes += sum(map(len, new)) + len(new) * (160 + 8 * self.width)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score, and how much likelier (log, at most one for each letter) its words are there than letters at random."""
        if not self.model.languages:
            return [(UNDECIDED, 0.0, 0.0)] * len(texts)
        # A full stop or comma ends a word like white space does; other signs are rarer.
        chunks = [(t or "").lower().replace(",", " ").replace(".", " ").split() for t in texts]
        wanted = set().union(*chunks)
        new = sorted(wanted.difference(self.index))
        if self.free + len(new) > len(self.table) or self.bytes > MEMO_BYTES:
            new = sorted(wanted)
            self._reset(len(new))
        if new:
            self._learn(new)
        at = self.index.__getitem__
        out = []
        for own in chunks:
            rows = self.table[list(map(at, own))]
            sums = rows.sum(axis=0)
            if not sums[-2]:
                out.append((UNDECIDED, 0.0, 0.0))
                continue
            logs = self.model.log_prior + sums[:-2]
            best = int(np.argmax(logs))
            letters = rows[:, -1]
            gain = float(np.clip(rows[:, best] + letters * np.log(BASE_LETTERS), -letters, letters).sum())
            out.append((self.model.languages[best], float(1.0 / np.exp(logs - logs[best]).sum()), gain))
        for chunk in new:
            if len(chunk) > MEMO_KEY:
                del self.index[chunk]
        return out


def runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``RUN_CHARS`` characters."""
    start, held = 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text or "")
        if held >= RUN_CHARS or end == len(texts):
            yield texts[start:end]
            start, held = end, 0


def with_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (and ``extra`` columns of ``docs``), one row per row.

    Every word of the text counts. ``score`` is the probability of the predicted language
    given the text. Null text, or text without a letter, is ``und`` with score 0; ties
    go to the language first by name. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *extra]

    @lean
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            found = [f for run in runs(batch["text"].tolist()) for f in scorer.predict(run)]
            out = batch[names].copy()
            out["lang_pred"] = [f[0] for f in found]
            out["score"] = [f[1] for f in found]
            yield out

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *extra, F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInPandas(predict, f"{kinds}, lang_pred string, score double")


def judged(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` and a column ``name`` of (lang_pred, score, gain); its own columns pass by the scorer untouched.

    ``gain`` tells how much likelier (natural log) the text's words are in the predicted language
    than if every letter were one of ``BASE_LETTERS`` at random, where no word counts for more than
    its number of letters, for or against; 0 where the language is undecided.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, gain double")
    @lean
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            found = [f for run in runs(batch.tolist()) for f in scorer.predict(run)]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "gain"])

    return docs.withColumn(name, predict(F.col(f"`{text_col}`").cast("string")))
