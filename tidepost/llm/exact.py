"""Exact duplicates through an extendible-hash index kept as files in the shared folder.

DataFrame functions only. A text's key is a 64-bit hash of its normalised form. The
directory maps the first bits of a key to a bucket; it doubles until every bucket holds at
most ``capacity`` entries, and buckets that were not overfull keep their smaller depth. Rows find
their bucket through the directory. Owner tasks each take a range of buckets: they bring the
parts of an entry together, chain entries whose key is the same but whose bytes differ, count
each group and elect the row that stays, and write their part of the index. Rows read
their group from the index.

An entry is a key and link (a second hash), not a row: rows are combined in a few parts per entry
before they move, so a text that a third of all rows share reaches its owner as a few
rows. Rows that share an entry are compared byte by byte with the entry's head text. Those
that differ (a true collision) chain behind the entry, told apart by their whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepost.llm.common import keep_rows, one_of_each, stored, text_of

#: Fixed by the definition of equal texts: space and U+0009 to U+000D.
IGNORED = (" ", "\t", "\n", "\v", "\f", "\r")
MAX_DEPTH = 24
#: Entries a bucket holds at most before it splits; parts of an entry before they meet at its owner.
CAPACITY = 4096
PARTS = 16
#: A group with at least one of this many rows is hot, so there are at most this many; their head texts are broadcast up to these bytes.
HOT_SHARE = 1000
HOT_BYTES = 16 << 20
#: The filter before texts are shuffled has at most 2 ** FILTER_WORDS rows of 64 bits.
FILTER_WORDS = 20


def normalised(text: Column) -> Column:
    for character in IGNORED:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def _top_bits(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def _keyed(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    text = text_of(text_col)
    norm = normalised(text)
    key, link = F.xxhash64(norm), F.xxhash64(norm, F.lit(1))
    if key_bits < 64:
        key, link = (F.shiftleft(_top_bits(h, key_bits), 64 - key_bits) for h in (key, link))
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.length(text).alias("points"),
        key.alias("key"),
        link.alias("link"),
        norm.alias("norm"),
    )


def _directory(index: DataFrame, capacity: int, key_bits: int) -> tuple[DataFrame, int]:
    """Directory slots (the first ``depth`` bits of a key) with their bucket.

    Doubles until no slot is overfull. A bucket's own depth is the smallest at which
    all entries below its prefix fit, so slots that were never overfull share a bucket.
    """
    deepest = min(MAX_DEPTH, key_bits)
    depth = 1
    while True:
        slots = index.groupBy(_top_bits(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("entries"))
        fullest = slots.agg(F.max("entries")).first()[0] or 0
        if fullest <= capacity or depth >= deepest:
            break
        depth = min(deepest, depth + max(1, (fullest // capacity).bit_length() - 1))
    own = F.lit(depth)
    for shallower in range(depth - 1, 0, -1):
        prefix = F.shiftrightunsigned(F.col("slot"), depth - shallower)
        fits = F.sum("entries").over(Window.partitionBy(prefix)) <= capacity
        own = F.when(fits & (own == shallower + 1), shallower).otherwise(own)
    slots = slots.withColumn("local_depth", own)
    bucket = F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - local_depth), {depth} - local_depth)")
    return slots.select("slot", bucket.alias("bucket"), "local_depth"), depth


def build_index(entries: DataFrame, capacity: int, key_bits: int) -> DataFrame:
    """``entries`` (a few rows for each key and link) with the bucket that the directory names and its local depth."""
    links = stored(entries.select("key", "link").distinct(), "exact-links")
    directory, depth = _directory(links, capacity, key_bits)
    slots = stored(directory, "exact-directory")
    return stored(entries.withColumn("slot", _top_bits(F.col("key"), depth)).join(slots, "slot").drop("slot"), "exact-placed")


def owned(placed: DataFrame) -> DataFrame:
    """Rows dealt to owner tasks, each with a range of buckets; what follows by bucket and key stays in its task."""
    return placed.repartitionByRange("bucket")


def _filtered(rows: DataFrame, columns: list[str], wanted: DataFrame) -> DataFrame:
    """Rows that may equal one of ``wanted`` in ``columns``, by a filter of bits; the others never move."""
    h = F.xxhash64(*columns)
    word, place = _top_bits(h, FILTER_WORDS), F.shiftrightunsigned(h, 64 - FILTER_WORDS - 6).bitwiseAND(63).cast("int")
    bits = (
        wanted.select(word.alias("__word"), place.alias("__place"))
        .groupBy("__word")
        .agg(F.bit_or(F.expr("shiftleft(1L, __place)")).alias("__bits"))
    )
    # At most 2 ** FILTER_WORDS rows, whatever the input: safe to broadcast.
    marked = rows.withColumn("__word", word).join(F.broadcast(bits), "__word")
    return marked.where(F.getbit(F.col("__bits"), place) == 1).select(*rows.columns)


def _chained(docs: DataFrame, suspects: DataFrame, id_col: str, text_col: str, key_bits: int, total: int) -> DataFrame | None:
    """Texts whose bytes differ from their entry's head: key, link, text_sha256, chain (from 1); None if there are none.

    Head texts go to the rows, where the bytes are compared. Entries with a thousandth of all rows or
    more, a thousand at most, are broadcast if their texts are small by their bytes, so their
    rows stay where they are.
    """
    rows = _keyed(docs, id_col, text_col, key_bits).select("doc_id", "key", "link", "norm")
    passed = _filtered(rows, ["key", "link"], suspects.select("key", "link"))
    # Only head rows move to find the heads; of rows with the head's id the one with its text.
    named = suspects.select("key", "link", F.col("head_id").alias("doc_id"), "head_sha", "rows")
    at_head = _filtered(rows, ["key", "link", "doc_id"], named.select("key", "link", "doc_id"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("key", "link", "doc_id")]
    found = at_head.alias("r").join(named.alias("h"), same[0] & same[1] & same[2]).where(F.sha2("r.norm", 256) == F.col("h.head_sha"))
    heads = stored(found.groupBy("r.key", "r.link").agg(F.min("r.norm").alias("head_norm"), F.max("h.rows").alias("rows")), "exact-head-texts")
    often = max(2, -(-total // HOT_SHARE))
    hot = heads.where(F.col("rows") >= often).select("key", "link", "head_norm")
    rest = heads.where(F.col("rows") < often).select("key", "link", "head_norm")
    size = hot.agg(F.sum(F.octet_length("head_norm"))).first()[0] or 0
    on, differs = ["key", "link"], F.col("norm") != F.col("head_norm")
    if size <= HOT_BYTES:
        keys = F.broadcast(hot.select("key", "link"))
        far = passed.join(F.broadcast(hot), on).where(differs).select("key", "link", "norm")
        near = passed.join(keys, on, "left_anti").join(rest, on).where(differs).select("key", "link", "norm")
        differing = far.unionByName(near)
    else:
        differing = passed.join(heads, on).where(differs).select("key", "link", "norm")
    texts = stored(differing.distinct(), "exact-differing")
    if texts.isEmpty():
        return None
    order = Window.partitionBy("key", "link").orderBy("norm")
    return texts.select("key", "link", F.sha2("norm", 256).alias("text_sha256"), F.row_number().over(order).alias("chain"))


def _with_group(entries: DataFrame, index: DataFrame, chains: DataFrame | None, total: int) -> DataFrame:
    """Rows with their group's size and elected row; groups of a thousandth of all rows or more are broadcast."""
    on = ["key", "link", "chain"]
    if chains is None:
        named = entries.withColumn("chain", F.lit(0))
    else:
        named = entries.join(chains, ["key", "link", "text_sha256"], "left").withColumn("chain", F.coalesce("chain", F.lit(0)))
    often = max(2, -(-total // HOT_SHARE))
    groups = index.select(*on, "group_size", "best", "rows")
    hot = F.broadcast(groups.where(F.col("rows") >= often).drop("rows"))  # HOT_SHARE rows at most
    rest = groups.where(F.col("rows") < often).drop("rows")
    return named.join(hot, on).unionByName(named.join(hot.select(*on), on, "left_anti").join(rest, on))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; also copies (equal rows) and points.

    Texts are equal if identical without space and U+0009 to U+000D. The row with the
    most code points in its original text stays, then the smallest id (null last).
    Null text counts as empty; all empty texts are one group. Rows that repeat an id with
    the same text and length all come back, and only one of them is kept. An empty table
    gives no rows. ``key_bits`` under 64 makes collisions likely and is meant for tests.
    """
    keyed = _keyed(docs, id_col, text_col, key_bits)
    entries = stored(
        keyed.select("doc_id", "points", "key", "link", F.sha2("norm", 256).alias("text_sha256"))
        .groupBy("doc_id", "points", "key", "link", "text_sha256")
        .agg(F.count("*").alias("copies")),
        "exact-entries",
    )
    total = entries.count()
    best = F.min(F.struct((-F.col("points")).alias("less"), F.isnull("doc_id").alias("no_id"), "doc_id"))
    part = F.pmod(F.xxhash64("doc_id", "points"), F.lit(PARTS))
    parts = (
        entries.groupBy("key", "link", "text_sha256", part.alias("part"))
        .agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"), best.alias("best"))
        .drop("part")
    )
    placed = build_index(stored(parts, "exact-parts"), capacity, key_bits)
    place = ["bucket", "local_depth", "key", "link"]
    heads = owned(placed).groupBy(*place).agg(F.sum("rows").alias("rows"), F.min(F.struct("best.no_id", "best.doc_id", "text_sha256")).alias("head"))
    heads = stored(
        heads.select(*place, "rows", F.col("head.doc_id").alias("head_id"), F.col("head.text_sha256").alias("head_sha")), "exact-heads"
    )
    chains = _chained(docs, heads.where("rows > 1"), id_col, text_col, key_bits, total)
    # Texts that differ from their entry's head form a chain behind it, by their bytes.
    named = placed.join(chains, ["key", "link", "text_sha256"], "left") if chains is not None else placed.withColumn("chain", F.lit(0))
    index = stored(
        owned(named.withColumn("chain", F.coalesce("chain", F.lit(0))))
        .groupBy(*place, "chain")
        .agg(F.sum("copies").alias("group_size"), F.sum("rows").alias("rows"), F.min("text_sha256").alias("chain_sha"), F.min("best").alias("best"))
        .sortWithinPartitions("bucket", "key", "link", "chain"),
        "exact-index",
    )
    rows = _with_group(entries, index, chains, total)
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("points") == -F.col("best.less"))
    return rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        stays.alias("stays"),
        "text_sha256",
        "copies",
        "points",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("stays") & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
        "copies",
        "points",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged."""
    kept = stored(exact_groups(docs, id_col, text_col).where("kept"), "exact-kept")
    text = text_of(text_col)
    sha = F.sha2(normalised(text), 256)
    on = {"doc_id": F.col(f"`{id_col}`"), "text_sha256": sha, "points": F.length(text)}
    repeated = kept.where("copies > 1")
    if repeated.isEmpty():
        return keep_rows(docs, kept, on)
    once = one_of_each(keep_rows(docs, repeated, on), [F.col(f"`{id_col}`"), sha])
    return keep_rows(docs, kept.where("copies = 1"), on).unionByName(once)
