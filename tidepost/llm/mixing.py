"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, once per pass. A copy's virtual
finish time is the words its source has queued up to and with it, divided by the source's
target. The copies of all sources are range-sorted by finish time and cut where the
running total reaches the budget, so that every source is served in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepost.llm.common import keep_rows, stored, text_of

#: Fixed by the contract: weights by rank of the source, share of all words, passes over a source.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
PASSES = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Rows per slice of a running total.
SLICE = 50_000


def size_of(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def targets(
    sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, passes: int = PASSES
) -> DataFrame:
    """source, source_size, target of each source; ``sizes`` has source and source_size.

    Sources by code point, null last, take the weights in turn and share ``budget`` times
    all words. No target is over ``passes`` times its source's size; what is over is shared
    anew by weight. The answer is the level at which it fits: with sources ordered by cap
    over weight, those whose share would be over their cap come first.
    One row per source meets in one window.
    """
    by_name = Window.orderBy(F.isnull("source"), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * passes).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.isnull("source"), F.encode("source", "UTF-8"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ratio = F.col("cap") / F.col("weight")
    leveled = ranked.withColumns({"level": level, "rank": F.row_number().over(order)})
    open_ranks = F.when(F.col("level") < ratio, F.col("rank"))
    leveled = leveled.withColumn("first_open", F.min(open_ranks).over(everything))
    final = F.max(F.when(F.col("rank") == F.col("first_open"), F.col("level"))).over(everything)
    capped = F.isnull("first_open") | (F.col("rank") < F.col("first_open"))
    return leveled.select(
        "source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("weight") * final).alias("target")
    )


def _running(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str, slice_of: Column) -> DataFrame:
    """Running total of ``value`` per ``keys``; no window holds more than a slice of the order."""
    sliced = df.withColumn("__slice", slice_of)
    sums = sliced.groupBy(*keys, "__slice").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col("__slice").alias("__at"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"),
    )
    on = F.col("__slice") == F.col("__at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = sliced.withColumn("__own", F.sum(value).over(within))
    return own.join(offsets, on).select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    budget: float = BUDGET,
    passes: int = PASSES,
    seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, passes_taken.

    Size is the number of words (null text: 0). ``taken`` counts the words of every copy
    that the mix takes. Documents are taken whole. A source's taken words differ from
    its target by about a document. Rows equal in id, source and size share their fate.
    Documents without words are never queued and take nothing; an empty table gives no rows.
    """
    entries = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size_of(text_col).alias("size")
        )
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("copies")),
        "mix-entries",
    )
    sizes = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    wanted = stored(targets(sizes, weights, budget, passes), "mix-targets")
    hashed = entries.where("size > 0").withColumn("at", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("words", F.col("size") * F.col("copies"))
    total_rows = entries.count()
    slices = max(1, -(-total_rows // SLICE))
    queued = _running(
        hashed, ["source"], [F.col("at"), F.col("doc_id"), F.col("size")], "words", "queued",
        F.floor((F.shiftrightunsigned("at", 32) / F.lit(2.0**32)) * slices).cast("int"),
    )
    name = wanted.select(F.col("source").alias("__source"), F.col("source_size").alias("words_of"), F.col("target").alias("goal"))
    timed = queued.join(F.broadcast(name) if _few(wanted) else name, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    timed = stored(timed.withColumn("first", F.col("queued") / F.col("goal")), "mix-queued")
    step = F.col("words_of") / F.col("goal")
    copies = timed.select(
        "words", F.explode(F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: F.col("first") + p * step)).alias("finish")
    )
    cut = _cut(copies, wanted, budget)
    times = F.lit(0)
    for p in range(passes):
        times = times + F.when(F.col("first") + F.lit(p) * step <= F.lit(cut), 1).otherwise(0)
    served = timed.select("doc_id", "source", "size", times.alias("passes_taken"))
    left = entries.select("doc_id", "source", "size", "copies")
    keys = served.select(*[F.col(c).alias(f"__{c}") for c in served.columns])
    on = F.col("size") == F.col("__size")
    for c in ("doc_id", "source"):
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = left.join(keys, on, "left").select(
        *left.columns, F.coalesce("__passes_taken", F.lit(0)).alias("passes_taken")
    )
    joined = joined.join(
        F.broadcast(name) if _few(wanted) else name, F.col("source").eqNullSafe(F.col("__source"))
    ).select("doc_id", "source", "size", F.col("words_of").alias("source_size"), F.col("goal").alias("target"), "passes_taken", "copies")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes_taken")).alias("taken"), "passes_taken"
    )


def _few(wanted: DataFrame, bound: int = 10_000) -> bool:
    """Whether the table of sources is small enough to broadcast."""
    return len(wanted.select(F.lit(1)).head(bound + 1)) <= bound


def _cut(copies: DataFrame, wanted: DataFrame, budget: float) -> float:
    """The latest finish time at which the mix is still within its budget."""
    total = wanted.agg(F.sum("source_size")).first()[0] or 0
    limit = total * budget
    # Range-sorted: each partition is a slice of the order, as it was written.
    ordered = stored(
        copies.repartitionByRange("finish").sortWithinPartitions("finish").withColumn("part", F.spark_partition_id()),
        "mix-order",
    )
    sums = ordered.groupBy("part").agg(F.sum("words").alias("sum"))
    ends = sums.select("part", F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("end"), "sum")
    last = ends.where(F.col("end") >= limit).orderBy("part").select("part", (F.col("end") - F.col("sum")).alias("before")).first()
    if last is None:
        return float("inf")
    # One partition of the sorted order holds the cut; sums by finish time within it.
    inside = ordered.where(F.col("part") == last["part"]).groupBy("finish").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(last["before"])
    fits = inside.select("finish", upto.alias("upto")).where(F.col("upto") <= limit).agg(F.max("finish")).first()[0]
    if fits is not None:
        return fits
    first = ordered.where(F.col("part") == last["part"]).agg(F.min("finish")).first()[0]
    return float(_before(first))


def _before(value: float) -> float:
    import math

    return math.nextafter(value, -math.inf)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, columns unchanged."""
    taken = stored(mix(docs, id_col, text_col, source_col, **options).where("passes_taken > 0").distinct(), "mix-taken")
    on = {
        "doc_id": F.col(f"`{id_col}`"),
        "source": F.col(f"`{source_col}`").cast("string"),
        "size": size_of(text_col),
    }
    out = None
    most = taken.agg(F.max("passes_taken")).first()[0] or 0
    for times in range(1, most + 1):
        rows = keep_rows(docs, taken.where(F.col("passes_taken") >= times), on)
        out = rows if out is None else out.unionByName(rows)
    return docs.limit(0) if out is None else out
