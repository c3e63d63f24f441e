"""URL verdicts from listed canonical URLs, behind a blocked Bloom filter.

A listed entry is a host and the beginning of a path. A URL can only meet entries that
equal one of its own (host suffix, path beginning) keys. Those keys are tested against a
blocked Bloom filter of the list (every key's bits lie in one block of 512); the few that
may be listed go to an exact hash join, which removes the filter's false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.llm.common import stored

BLOCK_WORDS = 8
MAX_BYTES = 16 << 20
BITS_PER_KEY = 12
PROBES = 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z in lower case; path: then up to ``? #``."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(__url, locate('://', __url) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _key(host, path) -> Column:
    return F.xxhash64(host, path)


def _positions(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its bits within the block (one row per hash)."""
    h = hashes.astype(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    bits = np.stack([(mixed >> np.uint64(9 * i + 1)) & np.uint64(511) for i in range(PROBES)], axis=1)
    return block.astype(np.int64), bits.astype(np.int64)


def bloom_filter(keys: DataFrame, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """Blocks of 512 bits over the hashes in ``keys.key``; never over ``max_bytes`` in all.

    A longer list makes the filter pass more, not err. Blocks are filled by tasks
    and joined by an aggregate per block, so only the bounded filter reaches the driver.
    """
    n = keys.count()
    blocks = max(1, min(max_bytes // 64, -(-n * BITS_PER_KEY // 512)))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block, bits = _positions(batch["key"].to_numpy(), blocks)
            cell = np.unique((block[:, None] * 512 + bits).ravel())
            yield pd.DataFrame({"word": cell >> 6, "bits": np.left_shift(np.int64(1), cell & 63)})

    set_bits = keys.mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(blocks * BLOCK_WORDS, dtype=np.uint64)
    for row in set_bits.toLocalIterator():  # at most max_bytes / 8 rows
        out[row["word"]] = np.uint64(row["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def may_hold(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, bits = _positions(hashes, len(filter_words) // BLOCK_WORDS)
    cell = block[:, None] * 512 + bits
    return ((filter_words[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def url_verdicts(
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per page: the id (as page_id), host, path, rule, verdict.

    ``listed`` has host, path and verdict. An entry fits its host and all subdomains if
    the URL's path starts with the entry's; the longest entry wins (host and path
    together, then the longer host). ``rule`` is the entry as ``host + path``, null if none
    fits; the verdict is then ``allow``. A null URL or one without ``://`` has an empty
    host and path. Entries that repeat count once (verdict: the first by name). Repeated
    pages come back one for one; an empty list allows all.
    """
    rules = stored(
        listed.select(F.lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict")),
        "url-rules",
    )
    # Distinct shapes of entries, bounded by the longest host and path.
    depths = [r[0] for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect()]
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    words = bloom_filter(rules.select(_key("host", "path").alias("key")), max_bytes)
    shared = pages.sparkSession.sparkContext.broadcast(words)

    named = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    parsed = named.select("page_id", host.alias("host"), path.alias("path"))
    if not depths:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    # The URL's own suffixes and prefixes of the listed sizes: one expression, however long the list.
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.lit(sorted(depths)), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), ".")
    )
    prefixes = F.transform(
        F.filter(F.lit(sorted(lengths)), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n)
    )
    possible = F.flatten(
        F.transform(suffixes, lambda h: F.transform("__prefixes", lambda p: F.struct(h.alias("host"), p.alias("path"))))
    )

    @F.pandas_udf("array<boolean>")
    def hits(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[] for _ in sizes])
        flat = may_hold(shared.value, np.concatenate([np.asarray(h, dtype=np.int64) for h in hashes if len(h)]))
        return pd.Series(list(np.split(flat, np.cumsum(sizes)[:-1])))

    tested = stored(
        parsed.withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__prefixes", prefixes)
        .withColumn("possible", possible)
        .withColumn("hit", hits(F.transform("possible", lambda k: F.xxhash64(k["host"], k["path"]))))
        .withColumn("passed", F.filter(F.arrays_zip("possible", "hit"), lambda z: z["hit"]))
        .select("__row", "page_id", "host", "path", "passed"),
        "url-tested",
    )
    probe = tested.select("__row", F.explode("passed.possible").alias("k")).select(
        "__row", F.col("k.host").alias("host"), F.col("k.path").alias("path")
    )
    if len(rules.select("host").head(10_001)) <= 10_000:
        rules = F.broadcast(rules)
    longest = (
        probe.join(rules, ["host", "path"])
        .groupBy("__row")
        .agg(
            F.max(
                F.struct(
                    (F.length("host") + F.length("path")).alias("total"), F.length("host").alias("h"), "host", "path", "verdict"
                )
            ).alias("won")
        )
    )
    return tested.join(longest, "__row", "left").select(
        "page_id",
        "host",
        "path",
        F.concat("won.host", "won.path").alias("rule"),
        F.coalesce("won.verdict", F.lit("allow")).alias("verdict"),
    )
