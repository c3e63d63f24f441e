"""Near duplicates by BagMinHash signatures of weighted word shingles.

A text is a multiset of five-word shingles. For each shingle, a Poisson process of points
(time, register, weight cell) runs on each of the dyadic weight intervals (0, 1], (1, 2],
(2, 4], ...; it depends on the shingle and the interval only. A text of weight ``w`` sees the
points of the intervals up to ``w``; in the topmost one the leading bits of a point's mark
split the interval again and again and tell whether its cell lies under ``w``. A register
keeps its earliest point. Two texts agree in a register with a probability of exactly
their weighted Jaccard similarity. Points are generated in order of time and only until every
register is filled, so a text costs about its length plus a constant.

Registers are banded. Texts with the same words are one node first. In each bucket of a band the
node that meets most others over all bands is the hub: every member is verified against
it on the exact shingle multisets, and verified links join nodes into classes. In buckets that
still hold several classes the members of different classes are compared exactly, block by
block, and give only the links that join classes. So no link between classes that a band
offers is lost, and no bucket is expanded into rows for all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.llm.common import keep_rows, lean, one_of_each, stored
from tidepost.llm.components import components
from tidepost.llm.shingles import mixed, runs, shingle_hashes, word_hashes

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 32, 4
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SLACK = 3.0
#: Most members, and about most shingles, of a block of a bucket.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20


def weighted_shingles(texts: list[str | None], width: int = SHINGLE):
    """(text, shingle, weight) of the distinct shingles of each text, and two digests of its words."""
    words, per_text, _ = word_hashes(texts)
    shingles, counts, _ = shingle_hashes(words, per_text, width)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    first = np.flatnonzero(new)
    weights = np.diff(np.append(first, len(owner)))
    place = np.arange(len(words)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    digests = []
    for salt in (1, 2):
        terms = mixed(words + mixed(place.astype(np.uint64) * np.uint64(2) + np.uint64(salt << 40)))
        sums = np.zeros(len(texts), dtype=np.uint64)
        filled = np.flatnonzero(per_text)
        if len(filled):
            sums[filled] = np.add.reduceat(terms, (np.cumsum(per_text) - per_text)[filled])
        digests.append(mixed(sums))
    return owner[first], shingles[first], weights, per_text, digests


def bag_min_hash(owner: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Earliest point of each register of each of ``n`` bags; bags without items stay at infinity."""
    out = np.full(n * registers, np.inf)
    if not len(owner):
        return out.reshape(n, registers)
    bags, seeds, low, size, top = [], [], [], [], []
    interval = 0
    while True:  # (0, 1], (1, 2], (2, 4], ...
        under = 0 if interval == 0 else 1 << (interval - 1)
        used = weights > under
        if not used.any():
            break
        bags.append(owner[used])
        seeds.append(mixed(items[used] ^ mixed(np.array([interval], dtype=np.uint64))))
        low.append(np.full(used.sum(), under))
        size.append(np.full(used.sum(), max(1, under)))
        top.append(weights[used])
        interval += 1
    bag, seed, low, size, top = map(np.concatenate, (bags, seeds, low, size, top))
    totals = np.bincount(owner, weights=weights, minlength=n)
    horizon = registers / np.maximum(totals, 1) * (np.log(registers) + SLACK)
    time = np.zeros(len(bag))
    live = np.arange(len(bag))
    state = seed
    fresh = True
    while len(live):
        waiting = []
        while len(live):
            if fresh:
                state[live] += GOLDEN
                draw = mixed(state[live])
                gap = -np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)
                time[live] += gap / size[live]
            fresh = True
            due = time[live] <= horizon[bag[live]]
            waiting.append(live[~due])
            live = live[due]
            mark = mixed(state[live] ^ np.uint64(0xD6E8FEB86659FD93))
            cell = low[live] + 1 + (((mark >> np.uint64(32)) * size[live].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            seen = live[cell <= top[live]]
            register = (mark[cell <= top[live]] % np.uint64(registers)).astype(np.int64)
            np.minimum.at(out, bag[seen] * registers + register, time[seen])
        unfilled = np.isinf(out.reshape(n, registers)).any(axis=1) & (totals > 0)
        if not unfilled.any():
            break
        horizon[unfilled] *= 2  # what waits there has drawn its next point already
        rest = np.concatenate(waiting)
        live, fresh = rest[unfilled[bag[rest]]], False
    return out.reshape(n, registers)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, -1)
    key = np.zeros(bits.shape[:2], dtype=np.uint64) + mixed(np.arange(bands, dtype=np.uint64))
    for i in range(bits.shape[2]):
        key = mixed(key ^ bits[:, :, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, d1, d2, words, bands of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = ["doc_id", "text_hash", "d1", "d2", "words", "bands"]

    @lean
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, hashes = batch["doc_id"].to_numpy(dtype=object), batch["text_hash"].to_numpy()
            for first, run in runs(batch["text"].tolist()):
                owner, items, weights, words, (d1, d2) = weighted_shingles(run, width)
                found = bag_min_hash(owner, items, weights, len(run), bands * rows)
                keys = band_keys(found, bands)
                part = slice(first, first + len(run))
                yield pd.DataFrame(
                    dict(zip(columns, (ids[part], hashes[part], d1.view(np.int64), d2.view(np.int64), words, list(keys))))
                )

    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    ).mapInPandas(sign, f"doc_id {id_type}, text_hash long, d1 long, d2 long, words long, bands array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """node, shingles: the multiset as a sorted set of hashes of (shingle, occurrence)."""

    @lean
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes = batch["node"].to_numpy()
            for first, run in runs(batch["text"].tolist()):
                owner, items, weights, _, _ = weighted_shingles(run, width)
                which = np.repeat(np.arange(len(items)), weights)
                occurrence = np.arange(len(which)) - np.repeat(np.cumsum(weights) - weights, weights)
                hashes = mixed(items[which] ^ mixed(occurrence.astype(np.uint64))).view(np.int64)
                owner = owner[which]
                order = np.lexsort((hashes, owner))
                sets = np.split(hashes[order], np.searchsorted(owner, np.arange(1, len(run))))
                yield pd.DataFrame({"node": nodes[first : first + len(run)], "shingles": sets})

    return texts.mapInPandas(expand, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of ``pairs`` whose shingle multisets overlap to at least ``least``."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))

    @lean
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for a, b in zip(batch["a_set"], batch["b_set"]):
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= least * (len(a) + len(b) - both))
            yield batch.loc[good, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInPandas(check, "a long, b long")


def linked_within(nodes, labels, sides, sets, least: float) -> list[tuple[int, int]]:
    """Links between different labels that join them, found on exact overlaps of all pairs of a block pair.

    ``sides``: 0 and 1 for the two blocks (all 0 if it is one block with itself). Overlaps are
    products of 0/1 matrices, taken for some thousands of shingles at a time.
    """
    sizes = np.array([len(x) for x in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = counts[inverse] > 1  # others lie in one set only
    number = (np.cumsum(counts > 1) - 1)[inverse[common]]
    owner = owner[common]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    top = int(number[-1]) + 1 if len(number) else 0
    for low in range(0, top, 4096):
        own = slice(*np.searchsorted(number, [low, low + 4096]))
        part = np.zeros((len(sets), min(4096, top - low)), dtype=np.float32)
        part[owner[own], number[own] - low] = 1
        both += part @ part.T
    similar = both >= least * (sizes[:, None] + sizes[None, :] - both)
    similar &= labels[:, None] != labels[None, :]
    if sides.any():
        similar &= sides[:, None] != sides[None, :]
    parent = {label: label for label in labels.tolist()}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1))):
        a, b = root(labels[i]), root(labels[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    least: float = LEAST,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size, kept; also text_hash and copies.

    Two texts are linked if the multisets of their ``width``-word shingles (lower case, words of
    letters and digits) overlap to at least ``least``; classes are what links connect. Texts
    of fewer words are one shingle. Documents without a word (null, empty) are alone, each
    its own class. One row of each class is kept: that of its smallest id (null last), where an id
    repeats the one whose text has the smaller hash, and of wholly repeated rows one.
    ``copies`` counts the rows with one id and text. An empty table gives no rows.
    """
    signed = stored(signatures(docs, id_col, text_col, width, bands, rows), "near-signatures")
    worded = signed.where("words > 0")
    nodes = stored(
        worded.groupBy("d1", "d2")
        .agg(F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "near-nodes",
    )
    labels = components(stored(_links(docs, text_col, nodes, width, least), "near-all-links"))
    classes = nodes.select("d1", "d2", "node").join(labels, "node", "left").select(
        "d1", "d2", F.coalesce("label", F.col("node")).alias("label")
    )
    rows_of = stored(
        worded.select("doc_id", "text_hash", "d1", "d2").join(classes, ["d1", "d2"]).select("doc_id", "text_hash", "label"), "near-rows"
    )
    # Rows that repeat an id and text in a class are one entry; one of them is kept.
    entries = rows_of.groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    best = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash"))
    sizes = entries.groupBy("label").agg(F.sum("copies").alias("class_size"), best.alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    grouped = entries.join(sizes, "label").select(
        "doc_id",
        F.col("best.doc_id").alias("class_id"),
        "class_size",
        stays.alias("first"),
        "text_hash",
        "copies",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    one = F.lit(1).cast("long")
    alone = signed.where("words = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), one.alias("class_size"), F.lit(True).alias("kept"), "text_hash", one.alias("copies")
    )
    return grouped.select(
        "doc_id", "class_id", "class_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_hash", "copies"
    ).unionByName(alone)


def _links(docs: DataFrame, text_col: str, nodes: DataFrame, width: int, least: float) -> DataFrame:
    entries = nodes.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(entries.join(shared, "key"), "near-members")
    met = stored(members.groupBy("node").agg(F.sum("n").alias("met")), "near-met")
    text = F.col(f"`{text_col}`").cast("string")
    wanted = nodes.join(met.select("node"), "node", "left_semi").select("node", F.col("text_hash").alias("hash"))
    found = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).join(
        wanted, F.col("text_hash") == F.col("hash")
    )
    sets = stored(shingle_sets(found.groupBy("node").agg(F.min("text").alias("text")), width), "near-sets")

    ranked = members.join(met, "node")
    hubs = ranked.groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("hub"))
    rest = stored(members.join(hubs, "key").where("node <> hub").select("key", "node", "hub"), "near-rest")
    pairs = rest.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = stored(verified(pairs, sets, least), "near-links")
    return links.unionByName(_links_between_classes(rest, components(links), sets, least))


def _links_between_classes(rest: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links in buckets whose members (without the hub, which met them all) still are of several classes.

    Such a bucket is cut into blocks of bounded size; every pair of its blocks is one
    piece of work, which compares its members of different classes and gives only the
    links that join classes: never more rows than members.
    """
    sizes = sets.select("node", F.size("shingles").alias("size"))
    named = rest.join(labels, "node", "left").join(sizes, "node")
    named = stored(
        named.select("key", "node", F.coalesce("label", F.col("node")).alias("class"), "size"), "near-classes"
    )
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    still = (
        named.groupBy("key")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"), blocks.cast("int").alias("blocks"))
        .where("low < high")
        .select("key", "blocks")
    )
    placed = named.join(still, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "node",
        "class",
    )
    columns = ["key", "i", "j", "side", "node", "class", "shingles"]

    @lean
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = (held[["key", "i", "j"]] != held[["key", "i", "j"]].shift()).any(axis=1)
            cuts = np.flatnonzero(new.to_numpy())
            yield found(held, cuts)
            held = held.iloc[cuts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield found(held, np.array([0, len(held)]))

    def found(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        nodes, classes = rows["node"].to_numpy(), rows["class"].to_numpy()
        sides, shingles = rows["side"].to_numpy(), rows["shingles"].tolist()
        out = []
        for low, high in zip(cuts[:-1], cuts[1:]):
            if high - low > 1 and (classes[low:high] != classes[low]).any():
                out += linked_within(nodes[low:high], classes[low:high], sides[low:high], shingles[low:high], least)
        return pd.DataFrame(out, columns=["a", "b"])

    return (
        dealt.join(sets, "node")
        .select(*columns)
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInPandas(compare, "a long, b long")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, columns unchanged.

    Rows are told apart by id and text, so null and repeated ids are no trouble; of rows
    alike in both one stays, but those without a word all stay. An empty table stays empty.
    """
    found = near_groups(docs, id_col, text_col, **options).where("kept").select("doc_id", "text_hash", "copies").distinct()
    kept = stored(found, "near-kept")
    doc_id, text_hash = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    on = {"doc_id": doc_id, "text_hash": text_hash}
    repeated = kept.where("copies > 1")
    if repeated.isEmpty():
        return keep_rows(docs, kept, on)
    once = one_of_each(keep_rows(docs, repeated, on), [doc_id, text_hash])
    return keep_rows(docs, kept.where("copies = 1"), on).unionByName(once)
