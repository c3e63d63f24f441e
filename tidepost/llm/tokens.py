"""Token counts: texts batched by bytes, long ones split where no token can cross."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.llm.common import lean
from tidepost.llm.encoders import ByteCounts, default_path

BATCH_BYTES = 1 << 20
SPLIT_CHARS = 1 << 16
#: A blank after a visible character starts a new token in every byte-level pattern used here.
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")


def segments(text: str, size: int) -> list[str]:
    """Parts of at most about ``size`` characters whose token counts add up to the text's.

    Cuts only before a blank that follows a visible character. A stretch without such
    a place stays whole.
    """
    parts, start = [], 0
    while len(text) - start > size:
        cut = BOUNDARY.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def with_token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    limit: int = 512,
    batch_bytes: int = BATCH_BYTES,
    split_chars: int = SPLIT_CHARS,
) -> DataFrame:
    """One row per document: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a byte-level vocabulary in the tokenizers format. Null text counts as empty
    (0 bytes, 0 tokens). Special strings inside texts count as the library counts them
    by default. Rows, repeated ones too, come back one for one; an empty table gives none.
    """
    path = path or default_path("byte_bpe_50k.json")
    id_type = docs.schema[id_col].dataType.simpleString()

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or ByteCounts(path)
            yield from _counted(batch, encoder, batch_bytes, split_chars)

    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        count, f"doc_id {id_type}, n_bytes long, n_tokens long"
    )
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def _counted(batch: pa.RecordBatch, encoder: ByteCounts, batch_bytes: int, split_chars: int):
    """Runs of rows of about ``batch_bytes`` of text are encoded together."""
    import pyarrow.compute as pc

    texts = batch.column(1)
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    lengths = sizes.to_numpy(zero_copy_only=False)
    start = 0
    while start < len(lengths):
        end, held = start, 0
        while end < len(lengths) and (end == start or held + lengths[end] <= batch_bytes):
            held += lengths[end]
            end += 1
        owners, parts = [], []
        for row, text in enumerate(texts.slice(start, end - start).to_pylist()):
            for part in segments(text or "", split_chars):
                owners.append(row)
                parts.append(part)
        totals = [0] * (end - start)
        for row, n in zip(owners, encoder.counts(parts)):
            totals[row] += n
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(start, end - start),
                sizes.slice(start, end - start).cast(pa.int64()),
                pa.array(totals, pa.int64()),
            ],
            names=["doc_id", "n_bytes", "n_tokens"],
        )
        start = end
