"""TF-IDF vectors of tokenised texts over a bounded vocabulary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_statistics(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``term, tf, df``: uses and documents of every term; the row of the null term has the number of documents in ``df``.

    One read and one aggregate: every batch of documents is counted by whole arrays, so a row per
    term and batch is shuffled at most. A row without tokens (null or empty) is a document without
    terms; null tokens are none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = pc.list_flatten(lists).dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, code = np.repeat(np.arange(len(sizes)), sizes)[code >= 0], code[code >= 0]
            n = len(coded.dictionary)
            cells = np.sort(row * max(1, n) + code)  # np.unique hashes, which is many times slower here
            once = cells[np.flatnonzero(np.diff(cells, prepend=-1))] % max(1, n)
            names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([None], pa.string())])
            uses = np.append(np.bincount(code, minlength=n), 0)
            held = np.append(np.bincount(once, minlength=n), len(sizes))
            yield pa.RecordBatch.from_arrays([names, pa.array(uses, pa.int64()), pa.array(held, pa.int64())], names=["term", "tf", "df"])

    counted = docs.select(tokens).mapInArrow(count, "term string, tf long, df long")
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(
    statistics: DataFrame, size: int = 1000, min_docs: int = 2, max_share: float = 0.95
) -> tuple[list[str], list[float], int]:
    """Terms in alphabetical order, their smoothed inverse document frequency, and the number of documents.

    Terms in fewer than ``min_docs`` documents or in more than ``max_share`` of them are left
    out; of the others the ``size`` most used stay (ties: alphabetically). At most ``size``
    terms reach the driver.
    """
    count = statistics.where("term IS NULL").agg(F.sum("df")).first()[0] or 0
    fit = (F.col("df") >= min_docs) & (F.col("df") <= max_share * count)
    top = statistics.where(F.col("term").isNotNull() & fit).orderBy(F.desc("tf"), "term").limit(size).collect()
    kept = sorted((r["term"], r["df"]) for r in top)
    return [t for t, _ in kept], [float(np.log((1 + count) / (1 + df)) + 1) for _, df in kept], count


def tfidf_vectors(docs: DataFrame, terms: Sequence[str], idf: Sequence[float], ord: str = "ord", tokens: str = "tokens") -> DataFrame:
    """``ord, terms, weights``: numbers of the terms of each document (ascending) and their weights, of length 1 together.

    A weight is the uses of a term times its ``idf``. Documents without a term of the
    vocabulary have empty arrays.
    """
    shared = docs.sparkSession.sparkContext.broadcast((list(terms), np.array(idf)))
    kind = docs.schema[ord].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        known, scale = shared.value
        for batch in batches:
            lists = batch.column(1)
            numbers = pc.index_in(pc.list_flatten(lists), pa.array(known, pa.string()))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            number = pc.fill_null(numbers, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)[number >= 0]
            cells, uses = np.unique(row * max(1, len(known)) + number[number >= 0], return_counts=True)
            row, number = np.divmod(cells, max(1, len(known)))
            weight = uses * scale[number] if len(cells) else np.zeros(0)
            places = np.searchsorted(row, np.arange(len(sizes) + 1))
            length = np.ones(len(sizes))
            full = np.flatnonzero(np.diff(places))
            if len(full):
                length[full] = np.sqrt(np.add.reduceat(weight * weight, places[full]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(places.astype(np.int32), pa.array(number.astype(np.int32))),
                    pa.ListArray.from_arrays(places.astype(np.int32), pa.array(weight / length[row] if len(cells) else weight)),
                ],
                names=["ord", "terms", "weights"],
            )

    return docs.select(F.col(ord).alias("ord"), tokens).mapInArrow(weigh, f"ord {kind}, terms array<int>, weights array<double>")
