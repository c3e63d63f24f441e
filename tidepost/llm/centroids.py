"""Centroid clustering in whole numbers with Spark's own expressions only.

Each component becomes an integer, so distances and sums are exact and no order of
summation can matter. A vector's distances to all centroids are one expression:
``zip_with`` and ``aggregate`` over each row of an array literal of centroids, and
``array_min`` of (distance, number) picks the nearest, the smaller number on ties. A round
is one read of the vectors and one aggregate of ``k`` groups whose column sums combine
before the shuffle; only these ``k`` rows of sums reach the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.llm.common import stored


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * component) of vectors with ``dims`` finite components and no other."""
    raw = F.col(f"`{vector_col}`")
    bad = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(raw, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(raw.isNotNull() & (F.size(raw) == dims) & ~bad).select(F.col(f"`{id_col}`").alias("vec_id"), whole.alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of ``seed`` and id (null ids last; ties by the vector itself)."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in whole.orderBy(order.asc_nulls_last(), "v").limit(k).collect()]


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid by squared distance, the smaller number on ties."""
    rows = [{"c": c, "norm": sum(x * x for x in c)} for c in centroids]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<c: array<bigint>, norm: bigint>>")  # folded to one literal

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)

    def of(own: Column) -> Column:
        # |v - c|^2 = |v|^2 + |c|^2 - 2 v.c; the same |v|^2 for all centroids is added behind the choice.
        return F.array_min(F.transform(table, lambda row, i: F.struct((row["norm"] - 2 * dot(own, row["c"])).alias("rest"), i.alias("cluster"))))

    def whole(own: Column) -> Column:
        best = F.transform(F.array(of(own)), lambda b: F.struct((b["rest"] + dot(own, own)).alias("distance"), b["cluster"].alias("cluster")))
        return F.get(best, F.lit(0))

    # As the variable of a lambda the vector is worked out once a row, not once a centroid.
    return F.get(F.transform(F.array(v), whole), F.lit(0))


def moved(whole: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: floor of the mean of each cluster's vectors; empty clusters keep their centroid."""
    dims = len(centroids[0])
    found = whole.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims)]
    out = list(centroids)
    for row in found.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows at most
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return out


def centroid_clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 40,
    dims: int = 64,
    rounds: int = 5,
    scale: int = 256,
    seed: str = "2:",
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components).

    Vectors that are null, have another number of components than ``dims``, or hold a null,
    NaN or infinite component take no part. With fewer than ``k`` vectors each is a centroid.
    Rows, repeated ones and those with null ids too, come back one for one; an empty table
    gives no rows. ``distance`` is a squared distance in steps of ``1 / scale``; components so
    large that it leaves 64 bits (beyond about a million at scale 256) raise an overflow error.
    Every round reads ``vectors`` once, so give a table rather than a costly plan.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, id_col, vector_col, dims, scale)
    kind = whole.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(whole, k, seed)
    if not centroids:
        columns = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], columns)
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    found = whole.select("vec_id", nearest(F.col("v"), centroids).alias("near"))
    placed = stored(found.select("vec_id", F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance")), "centroid-clusters")
    own = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    total = sum(own.values())
    facts = [(c, own[c], total, centroids[c]) for c in sorted(own)]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """Lower-case hex sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)

