"""Packing token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt at random into blocks of bounded size. Each block is packed on several
islands, tasks of their own with populations of their own; after each epoch every island
sends its elite (its best packing) to the next island of the block, by a shuffle. A child
is made by injecting whole well-filled bins of one parent into another, removing the bins
that now hold a piece twice, and putting the displaced pieces back by best fit.

After a round, bins under ``keep_fill`` are dissolved and their pieces dealt into fewer
blocks, until one block holds what is left. No task ever holds more than a block.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.llm.common import fresh, lean, stored
from tidepost.llm.encoders import WordIds, default_path
from tidepost.llm.shingles import runs

CAPACITY = 2048
END_ID = 0


# ---- pieces -----------------------------------------------------------------------------


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, and ids if asked.

    A document's ids are those of its whole text (null: empty) and then ``END_ID``. Only
    longer documents are cut, into pieces of ``capacity`` ids and a last one that may be
    shorter. Repeated rows give repeated pieces; an empty table gives none.
    """
    path = path or default_path("word_bpe_49k.json")
    id_type = docs.schema[id_col].dataType.simpleString()
    end = struct.pack("<I", END_ID)

    @lean
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for batch in batches:
            encoder = encoder or WordIds(path)
            keys = batch["doc_id"].tolist()
            for first, run in runs(batch["text"].tolist()):
                rows = []
                for key, own in zip(keys[first : first + len(run)], encoder.ids([t or "" for t in run])):
                    own += end
                    for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[at : at + 4 * capacity]
                        row = (key, piece, at // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, part) if keep_ids else row)
                yield pd.DataFrame(rows, columns=columns)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInPandas(cut, schema)


# ---- the algorithm inside a task -----------------------------------------------------------


def best_fit(bins: list[list[int]], rooms: list[int], items, lengths, capacity: int) -> None:
    """Put ``items`` (in the given order) into the fullest bins that still have room; open new ones."""
    mask = 0
    by_room: dict[int, list[int]] = {}
    for b, room in enumerate(rooms):
        if room:
            by_room.setdefault(room, []).append(b)
            mask |= 1 << room
    for item in items:
        size = lengths[item]
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
            bins[b].append(item)
        else:
            room = capacity
            b = len(bins)
            bins.append([item])
            rooms.append(0)
        left = room - size
        rooms[b] = left
        if left:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left


def fitness(rooms: list[int], capacity: int) -> tuple[int, int]:
    """Fewer bins first, then uneven fills: sum of squared rooms, which leaves one bin emptiest."""
    return (-len(rooms), sum(r * r for r in rooms))


def crossover(receiver, donor, lengths, capacity: int, share: float, rng: random.Random):
    """Child of ``receiver`` with some of the best-filled bins of ``donor``."""
    bins_a, _ = receiver
    bins_b, rooms_b = donor
    order = sorted(range(len(bins_b)), key=lambda b: (rooms_b[b], rng.random()))
    injected = [b for b in order[: max(1, len(order) // 2)] if rng.random() < share] or order[:1]
    taken = bytearray(len(lengths))
    for b in injected:
        for item in bins_b[b]:
            taken[item] = 1
    bins, rooms, displaced = [list(bins_b[b]) for b in injected], [rooms_b[b] for b in injected], []
    for own in bins_a:
        if any(taken[i] for i in own):
            displaced.extend(i for i in own if not taken[i])
        else:
            bins.append(list(own))
            rooms.append(capacity - sum(lengths[i] for i in own))
    displaced.sort(key=lambda i: -lengths[i])
    best_fit(bins, rooms, displaced, lengths, capacity)
    return bins, rooms


def first_population(lengths, capacity: int, population: int, rng: random.Random, elite=None):
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [elite] if elite else []
    while len(people) < population:
        bins, rooms = [], []
        best_fit(bins, rooms, order, lengths, capacity)
        people.append((bins, rooms))
        noise = [lengths[i] * (1 + 0.15 * rng.random()) for i in range(len(lengths))]
        order = sorted(range(len(lengths)), key=lambda i: -noise[i])
    return people


def evolve(lengths, capacity: int, seed: int, elites, generations: int, population: int):
    """Best packing after some generations. ``elites`` are packings that came from islands (or none)."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    people = list(elites[:population])
    if not people or len(people[0][0]) > least:
        people = people + first_population(lengths, capacity, max(1, population - len(people)), rng)
    people.sort(key=lambda p: fitness(p[1], capacity), reverse=True)
    for _ in range(generations):
        if len(people[0][0]) <= least or len(people) < 2:
            break  # no packing can be better
        a, b = rng.sample(range(len(people)), 2)
        if rng.random() < 0.5:
            a, b = b, a
        child = crossover(people[a], people[b], lengths, capacity, 0.6, rng)
        people[-1] = child if fitness(child[1], capacity) > fitness(people[-1][1], capacity) else people[-1]
        people.sort(key=lambda p: fitness(p[1], capacity), reverse=True)
    return people[0]


def _packing(bin_of, lengths, capacity: int):
    bins: dict[int, list[int]] = {}
    for item, b in enumerate(bin_of):
        bins.setdefault(b, []).append(item)
    out = list(bins.values())
    return out, [capacity - sum(lengths[i] for i in own) for own in out]


def _labels(packing, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(packing[0]):
        for item in items:
            out[item] = b
    return out


# ---- islands on Spark --------------------------------------------------------------------


def _pack_round(
    pieces: DataFrame, number: int, block: int, rows: int, islands: int, epochs: int, generations: int,
    population: int, capacity: int,
) -> DataFrame:
    """``pieces`` (uid, length) with block and bin, packed on ``islands`` islands a block."""
    blocks = max(1, -(-rows // block))
    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(blocks)).alias("block"))
    # Each block's lengths go to its islands as one bounded row.
    state = (
        dealt.groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
        .select("block", "items.uid", "items.length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
        .withColumn("elites", F.array().cast("array<array<int>>"))
    )

    @lean
    def live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = []
            for row in batch.itertuples(index=False):
                lengths = [int(x) for x in row.length]
                elites = [_packing(list(e), lengths, capacity) for e in row.elites]
                elites.sort(key=lambda p: fitness(p[1], capacity), reverse=True)
                seed = zlib.crc32(f"{number}/{row.block}/{row.island}/{len(elites)}".encode())
                best.append(evolve(lengths, capacity, seed, elites, generations, population))
            batch = batch.drop(columns=["elites"])
            batch["bins"] = [_labels(p, len(length)) for p, length in zip(best, batch["length"])]
            batch["n_bins"] = [len(p[0]) for p in best]
            batch["rooms"] = [sum(r * r for r in p[1]) for p in best]
            yield batch

    schema = "block long, uid array<long>, length array<long>, island int, bins array<int>, n_bins int, rooms long"
    for _ in range(epochs - 1):
        lived = state.repartition("block", "island").mapInPandas(live, schema)
        # The elite of island i migrates to island i + 1; each island also keeps its own.
        moves = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)))).alias("to")
        state = (
            lived.select("block", moves, "uid", "length", "bins")
            .groupBy("block", F.col("to").alias("island"))
            .agg(F.first("uid").alias("uid"), F.first("length").alias("length"), F.collect_list("bins").alias("elites"))
            .select("block", "uid", "length", "island", F.array_sort("elites").alias("elites"))
        )
    lived = state.repartition("block", "island").mapInPandas(live, schema)
    best = lived.groupBy("block").agg(
        F.min(F.struct("n_bins", (-F.col("rooms")).alias("less"), "island", "uid", "length", "bins")).alias("best")
    )
    return best.select("block", F.explode(F.arrays_zip("best.uid", "best.length", "best.bins")).alias("p")).select(
        "block", F.col("p.uid").alias("uid"), F.col("p.length").alias("length"), F.col("p.bins").alias("bin")
    )


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    block: int = 1500,
    islands: int = 2,
    epochs: int = 2,
    generations: int = 6,
    population: int = 4,
    keep_fill: float = 0.995,
) -> DataFrame:
    """``pieces`` with sequence_id and offset: as few sequences of ``capacity`` as the search finds.

    ``pieces`` needs length (1 to ``capacity``; others are refused). Pieces of the full
    length are sequences of their own. Every piece is placed once; within a sequence
    offsets are gapless from 0. Numbers of sequences say nothing. Other columns stay.
    """
    key = fresh(pieces, "__uid")
    work = stored(pieces.withColumn(key, F.monotonically_increasing_id()), "pack-pieces")
    bad = work.where((F.col("length") < 1) | (F.col("length") > capacity) | F.isnull("length"))
    if not bad.isEmpty():
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    left = work.where(F.col("length") < capacity).select(F.col(key).alias("uid"), "length")
    full = work.where(F.col("length") == capacity).select(
        F.col(key).alias("uid"), F.col(key).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    done, number, rows = [full], 1, left.count()
    while rows:
        placed = stored(
            _pack_round(left, number, block, rows, islands, epochs, generations, population, capacity).select(
                "uid", "length", F.expr(f"-({number}L * shiftleft(1L, 56) + block * shiftleft(1L, 20) + bin) - 1").alias("sequence_id")
            ),
            "pack-round",
        )
        fill = placed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        loose = fill.where(F.col("fill") < keep_fill * capacity)
        more = rows > block
        if more:
            again = stored(placed.join(loose, "sequence_id", "left_semi").select("uid", "length"), "pack-loose")
            next_rows = again.count()
            more = 0 < next_rows < 0.9 * rows
        if more:
            placed = placed.join(loose, "sequence_id", "left_anti")
            left, rows, number = again, next_rows, number + 1
        else:
            rows = 0
        # At most ``capacity`` pieces share a sequence, so this window holds a bounded group.
        offset = F.expr(
            "sum(length) OVER (PARTITION BY sequence_id ORDER BY uid ROWS UNBOUNDED PRECEDING) - length"
        )
        done.append(placed.select("uid", "sequence_id", offset.alias("offset")))
    places = done[0]
    for other in done[1:]:
        places = places.unionByName(other)
    return work.join(places.withColumnRenamed("uid", key), key).drop(key)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, **search) -> DataFrame:
    """Pieces of ``docs`` with their place in sequences. See :func:`token_pieces` and :func:`pack`."""
    return pack(token_pieces(docs, id_col, text_col, keep_ids=keep_ids), **search)
