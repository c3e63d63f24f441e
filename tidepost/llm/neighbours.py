"""Exact top-k inner products by a Voronoi join.

Vectors are whole numbers, floor(scale * x). Pivots from a bounded sample cut the space into
Voronoi cells. Queries of a cell form a group with radius R (largest distance to its pivot p).
Each query is first solved within its own cell: the k-th best score there is one that its k-th
neighbour reaches at least. Where a cell holds too few rows, summaries of the data (per cell
and distance shell: number of vectors, largest distance) give such a score for the group:

    q.x >= p.c - R |c| - (|p| + R) d   for x within d of its pivot c.

A data vector x can score at most p.x + R |x| with any query of the group, so it is replicated
only to other groups whose least score that reaches. Groups and what reaches them are cut into
blocks of bounded size; each pair of blocks is solved on its own, and the k best of all blocks are the
answer. How many groups a row reaches depends on the data: see ``replicas_per_row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidepost.llm.common import lean, stored

SCALE = 64
QUERIES_PER_PIVOT = 32
MOST_PIVOTS = 1024
SHELLS = 16
BLOCK_QUERIES, BLOCK_ROWS = 1024, 8192
#: Rows that a task holds against all pivots at a time.
ROWS_AT_ONCE = 1024


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """uid, vec_id, v of the rows that take part: not null, no null or non-finite component."""
    raw = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(raw.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(f"`{id_col}`").alias("vec_id"),
        F.transform(raw, lambda x: F.floor(x * float(scale)).cast("long")).alias("v"),
    )


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Groups:
    """Rows in their cells, the queries' best scores in their own cell, and what each group must be sent."""

    def __init__(self, table: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int, per_pivot: int, most_pivots: int):
        self.id_type, self.k = table.schema[id_col].dataType.simpleString(), k
        flagged = whole_vectors(table, id_col, vector_col, scale).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
        vectors = stored(flagged, "knn-vectors")
        width, self.queries = vectors.agg(F.max(F.size("v")), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0))).first()
        self.width = max(1, width or 0)
        if not self.queries:
            return
        wanted = max(1, min(most_pivots, self.queries // per_pivot))
        # A bounded sample, the same on every run.
        sample = vectors.orderBy(F.xxhash64("v"), "uid").limit(wanted).select("v").collect()
        self.pivots = _matrix([r["v"] for r in sample], self.width)
        self.placed = stored(self._cells(vectors), "knn-cells")
        counts = self.placed.groupBy("cell").agg(F.count("*").alias("n"))
        at_home = self.placed.select("uid", "vec_id", "v", "cell")
        self.home = stored(best_rows(self._solved(at_home, counts), k), "knn-home")
        floors, radii = _bounds(self.placed, self.pivots, k)
        # A group needs the least of its queries' k-th scores; it is known if each of them has k rows at home.
        of_query = self.home.groupBy("cell", "query_uid").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        known = of_query.where(F.col("n") == k).groupBy("cell").agg(F.min("kth").alias("kth"), F.count("*").alias("n"))
        asked = self.placed.where("is_query").groupBy("cell").agg(F.count("*").alias("n"))
        for row in known.join(asked, ["cell", "n"]).collect():  # at most one row for each pivot
            floors[row["cell"]] = max(floors[row["cell"]], row["kth"])
        shared = table.sparkSession.sparkContext.broadcast((self.pivots, floors, radii))
        width = self.width

        def within_reach(batch: pd.DataFrame) -> Iterator[np.ndarray]:
            """For slices of the batch, in order: which groups, other than its own cell's, each row can score for."""
            p, low, radius = shared.value
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[at : at + ROWS_AT_ONCE]
                x = _matrix(part["v"].tolist(), width)
                reach = x @ p.T + np.sqrt((x * x).sum(axis=1))[:, None] * np.maximum(radius, 0)
                can = (radius >= 0) & (reach + 1e-6 * (1 + np.abs(reach)) >= low)
                can[np.arange(len(x)), part["cell"].to_numpy()] = False
                yield can

        self.within_reach = within_reach

    def _cells(self, vectors: DataFrame) -> DataFrame:
        shared, width = vectors.sparkSession.sparkContext.broadcast(self.pivots), self.width

        @lean
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = shared.value
            for whole in batches:
                for at in range(0, len(whole), ROWS_AT_ONCE):
                    batch = whole.iloc[at : at + ROWS_AT_ONCE]
                    x = _matrix(batch["v"].tolist(), width)
                    squares = (p * p).sum(axis=1) - 2 * x @ p.T
                    cell = squares.argmin(axis=1)
                    distance = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
                    yield batch[["uid", "vec_id", "v", "is_query"]].assign(cell=cell.astype(np.int32), distance=distance)

        schema = f"uid long, vec_id {self.id_type}, v array<long>, is_query boolean, cell int, distance double"
        return vectors.mapInPandas(assign, schema)

    def sent(self) -> DataFrame:
        """cell, n: rows that reach each group from other cells."""
        within_reach, pivots = self.within_reach, len(self.pivots)

        @lean
        def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                counts = sum((can.sum(axis=0) for can in within_reach(batch)), start=np.zeros(pivots, np.int64))
                cells = np.flatnonzero(counts)
                yield pd.DataFrame({"cell": cells.astype(np.int32), "n": counts[cells]})

        return self.placed.select("v", "cell").mapInPandas(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))

    def from_afar(self) -> DataFrame:
        """What each query scores with rows of other cells that can be among its best."""
        within_reach = self.within_reach

        @lean
        def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cells = [np.flatnonzero(row).astype(np.int32) for can in within_reach(batch) for row in can]
                yield batch[["uid", "vec_id", "v"]].assign(cells=pd.Series(cells, index=batch.index, dtype=object))

        # Python names the groups only; the copies are made where they are shuffled, one at a time.
        schema = f"uid long, vec_id {self.id_type}, v array<long>, cells array<int>"
        named = self.placed.select("uid", "vec_id", "v", "cell").mapInPandas(reached, schema)
        rows = named.select("uid", "vec_id", "v", F.explode("cells").alias("cell"))
        return self._solved(rows, self.sent())

    def _solved(self, rows: DataFrame, counts: DataFrame) -> DataFrame:
        """Blocks of queries against blocks of the ``rows`` of their cell; ``counts`` of rows by cell."""
        k, width = self.k, self.width
        chunks = self.placed.where("is_query").groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("chunks"))
        sizes = chunks.join(counts, "cell").select("cell", "chunks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
        sizes = F.broadcast(stored(sizes, "knn-sizes"))  # at most one row for each pivot
        asked = (
            self.placed.where("is_query")
            .join(sizes, "cell")
            .withColumn("chunk", F.expr("cast(pmod(xxhash64(uid), chunks) AS int)"))
            .withColumn("block", F.expr("explode(sequence(0, blocks - 1))"))
            .select(*[F.col(c).alias(c) for c in ("cell", "chunk", "block", "uid", "vec_id", "v")])  # both sides stem from one table
        )
        data = (
            rows.join(sizes, "cell")
            .withColumn("block", F.expr("cast(pmod(xxhash64(uid), blocks) AS int)"))
            .withColumn("chunk", F.expr("explode(sequence(0, chunks - 1))"))
            .select("cell", "chunk", "block", "uid", "vec_id", "v")
        )
        keys = ["cell", "chunk", "block"]

        def solve(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            columns = ["cell", "query_uid", "query_id", "uid", "vec_id", "score"]
            if not len(asked) or not len(rows):
                return pd.DataFrame(columns=columns)
            rows = rows.sort_values(["vec_id", "uid"], kind="stable", na_position="last")
            scores = _matrix(asked["v"].tolist(), width) @ _matrix(rows["v"].tolist(), width).T
            own, ids, cell = rows["uid"].to_numpy(), rows["vec_id"].to_numpy(), int(asked["cell"].iloc[0])
            out = []
            for i, uid in enumerate(asked["uid"]):
                line = np.where(own == uid, -np.inf, scores[i])
                if len(line) > k:
                    least = np.partition(line, len(line) - k)[len(line) - k]
                    at = np.flatnonzero(line >= least)
                else:
                    at = np.arange(len(line))
                at = at[np.argsort(-line[at], kind="stable")][:k]
                at = at[np.isfinite(line[at])]
                out.append((np.full(len(at), i), at, line[at].astype(np.int64)))
            query, at, score = (np.concatenate(x) for x in zip(*out))
            asked_uid, asked_id = asked["uid"].to_numpy()[query], asked["vec_id"].to_numpy()[query]
            return pd.DataFrame(dict(zip(columns, (cell, asked_uid, asked_id, own[at], ids[at], score))), index=range(len(at)))

        schema = f"cell int, query_uid long, query_id {self.id_type}, uid long, vec_id {self.id_type}, score long"
        return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, schema)


def best_rows(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, with their rank."""
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    per_pivot: int = QUERIES_PER_PIVOT,
    most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest scores among all other rows.

    ``is_query`` is an expression over ``vec_id``. Ties go to the smaller id (null last). Rows that
    repeat an id are candidates of each other. Null vectors and those with null or non-finite
    components take no part; rows with a null id do. Shorter vectors, empty ones too, count as ending in
    zeros. A query without another row, and an empty table, give no rows. Scores are exact below
    2 ** 53. A group has about ``per_pivot`` queries, or more beyond ``most_pivots`` groups.
    """
    groups = Groups(table, is_query, k, id_col, vector_col, scale, per_pivot, most_pivots)
    if not groups.queries:
        columns = f"query_id {groups.id_type}, rank int, vec_id {groups.id_type}, score long"
        return table.sparkSession.createDataFrame([], columns)
    found = groups.home.drop("rank").unionByName(groups.from_afar())
    return best_rows(found, k).select("query_id", "rank", "vec_id", "score")


def replicas_per_row(table: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, per_pivot: int = QUERIES_PER_PIVOT) -> tuple[float, int]:
    """How many groups other than its own cell's a row is sent to, on average, and the number of groups."""
    groups = Groups(table, is_query, k, "vec_id", "embedding", scale, per_pivot, MOST_PIVOTS)
    return (groups.sent().agg(F.sum("n")).first()[0] or 0) / groups.placed.count(), len(groups.pivots)


def _bounds(placed: DataFrame, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group: the score its k-th neighbour reaches at least, and its radius (-1: no queries)."""
    radii = np.full(len(pivots), -1.0)
    for row in placed.where("is_query").groupBy("cell").agg(F.max("distance").alias("r")).collect():
        radii[row["cell"]] = row["r"]
    widest = placed.agg(F.max("distance")).first()[0] or 1.0
    shell = F.least(F.floor(F.col("distance") / F.lit(max(widest, 1e-9)) * SHELLS), F.lit(SHELLS - 1)).cast("int")
    # At most MOST_PIVOTS * SHELLS rows.
    shells = placed.groupBy("cell", shell.alias("shell")).agg(F.count("*").alias("n"), F.max("distance").alias("d")).collect()
    norms = np.sqrt((pivots**2).sum(axis=1))
    floors = np.full(len(pivots), -np.inf)
    for group, radius in enumerate(radii):
        if radius < 0:
            continue
        least = sorted(
            (
                (
                    float(pivots[group] @ pivots[s["cell"]] - radius * norms[s["cell"]] - (norms[group] + radius) * s["d"]),
                    s["n"],
                )
                for s in shells
            ),
            reverse=True,
        )
        held = 0
        for score, n in least:
            held += n
            if held >= k + 1:  # one of them may be the query itself
                floors[group] = score
                break
    return floors, radii
