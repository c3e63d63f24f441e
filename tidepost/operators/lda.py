"""Topics by batch variational Bayes over weighted term vectors.

A round reads every document once: the topic mixture of each is fitted against the current
topics, in Arrow batches and whole arrays, and its expected term uses are added up per
(topic, term). These sums are whole numbers of a fixed small unit, so neither partitions nor
batches nor the order of tasks can change a bit of the result. Only the ``topics x terms``
table of sums moves; documents stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Expected uses are counted in units of 1 / UNIT.
UNIT = 2.0**32
TINY = 1e-100
#: Terms of documents that are fitted at a time: whole arrays of so many stay in a core's cache.
CELLS = 1 << 15


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of the gamma function for positive ``x``, to about 1e-11."""
    out = np.zeros_like(x)
    for i in range(6):
        out -= 1.0 / (x + i)
    y = x + 6.0
    r = 1.0 / (y * y)
    return out + np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def expected_logs(counts: np.ndarray) -> np.ndarray:
    """exp of the expected log shares under a Dirichlet distribution, per row."""
    return np.exp(digamma(counts) - digamma(counts.sum(axis=-1, keepdims=True)))


def first_topics(terms: list[str], topics: int, seed: int) -> np.ndarray:
    """Start values around 1 from a hash of seed, topic and term."""

    def draw(topic: int, term: str) -> float:
        return 0.8 + 0.4 * int(hashlib.md5(f"{seed}:{topic}:{term}".encode()).hexdigest()[:8], 16) / 2.0**32

    return np.array([[draw(k, t) for t in terms] for k in range(topics)]).reshape(topics, len(terms))


def _norms(mixture: np.ndarray, own: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """For every term of every document, what its topics give it together."""
    norm = np.full(len(own[0]), TINY)
    for topic, values in enumerate(own):
        norm += np.repeat(mixture[:, topic], sizes) * values
    return norm


def fit_documents(
    sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, shares: np.ndarray, prior: float, steps: int, tolerance: float
) -> list[np.ndarray]:
    """The expected uses of each term of each document, one array for each topic.

    ``sizes`` cuts ``terms`` and ``weights`` into documents; none is empty. A document
    is done when its counts change by less than ``tolerance`` on average, whatever the others do.
    """
    own = [row[terms] for row in shares]
    counts = np.ones((len(sizes), len(shares)))
    # The documents at hand; those that are done leave when they are a quarter.
    at, going = np.arange(len(sizes)), np.ones(len(sizes), dtype=bool)
    near, heavy, held = own, weights, sizes
    for _ in range(steps):
        mixture = expected_logs(counts[at])
        ratio = heavy / _norms(mixture, near, held)
        starts = np.cumsum(held) - held
        sums = np.stack([np.add.reduceat(values * ratio, starts) for values in near], axis=1)
        new = prior + mixture * sums
        moved = np.abs(new - counts[at]).sum(axis=1) / len(shares)
        counts[at[going]] = new[going]
        going &= moved >= tolerance
        if not going.any():
            break
        if going.mean() < 0.75:
            kept = np.repeat(going, held)
            near, heavy, held = [values[kept] for values in near], heavy[kept], held[going]
            at, going = at[going], np.ones(going.sum(), dtype=bool)
    mixture = expected_logs(counts)
    ratio = weights / _norms(mixture, own, sizes)
    return [np.repeat(mixture[:, topic], sizes) * values * ratio for topic, values in enumerate(own)]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of documents of about ``CELLS`` terms together."""
    run = (np.cumsum(sizes) - sizes) // CELLS
    first = np.flatnonzero(np.diff(run, prepend=-1))
    yield from zip(first.tolist(), [*first[1:].tolist(), len(sizes)])


def _round(vectors: DataFrame, topics: np.ndarray, prior: float, steps: int, tolerance: float) -> np.ndarray:
    """Topics after one round over all documents."""
    k, size = topics.shape
    shared = vectors.sparkSession.sparkContext.broadcast(expected_logs(topics))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            lists = batch.column(0)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            terms = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
            weights = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            bounds = np.unique(bounds - bounds[0])  # empty documents bound nothing
            sizes = np.diff(bounds)
            for first, end in _slices(sizes) if len(sizes) else ():
                part = slice(bounds[first], bounds[end])
                fitted = fit_documents(sizes[first:end], terms[part], weights[part], shared.value, prior, steps, tolerance)
                for topic, uses in enumerate(fitted):
                    whole = np.rint(uses * UNIT)
                    # sums of whole numbers under 2 ** 53 are exact in any order; halves keep them there
                    high = np.floor(whole * 2.0**-20)
                    top = np.bincount(terms[part], weights=high, minlength=size).astype(np.int64)
                    rest = np.bincount(terms[part], weights=whole - high * 2.0**20, minlength=size).astype(np.int64)
                    sums[topic] += (top << 20) + rest
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums.ravel()[cells])], names=["cell", "uses"])

    found = vectors.select("terms", "weights").mapInArrow(count, "cell long, uses long")
    total = np.zeros(k * size)
    # at most topics x terms rows
    for row in found.groupBy("cell").agg(F.sum(F.col("uses").cast("decimal(38,0)")).alias("uses")).collect():
        total[row["cell"]] = float(row["uses"]) / UNIT
    shared.destroy()
    return total.reshape(k, size) + prior


def variational_topics(
    vectors: DataFrame,
    terms: list[str],
    topics: int = 5,
    rounds: int = 10,
    steps: int = 100,
    tolerance: float = 1e-3,
    seed: int = 42,
) -> np.ndarray:
    """The ``topics x terms`` table of unnormalised topics after ``rounds`` rounds over all of ``vectors``.

    ``vectors`` has ``terms`` and ``weights`` (see ``tfidf_vectors``) and is read in every round,
    so give a stored table. Both priors are ``1 / topics``. A document takes at most ``steps``
    steps in a round.
    """
    found = first_topics(terms, topics, seed)
    for _ in range(rounds):
        found = _round(vectors, found, 1.0 / topics, steps, tolerance)
    return found
