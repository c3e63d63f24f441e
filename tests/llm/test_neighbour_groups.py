"""Groups of the neighbour join: what is sent falls with how clustered the data are; the answer is exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepost.llm import neighbours

KIND = "vec_id long, embedding array<float>"


def clustered(spark, spread, n=1200):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 4
    return spark.createDataFrame([(i, (centres[i % 12] + spread * rng.normal(size=16)).tolist()) for i in range(n)], KIND)


def brute(table, k):
    rows = [(r.vec_id, np.floor(64 * np.array(r.embedding, dtype=np.float32).astype(float))) for r in table.collect()]
    out = []
    for at, (i, q) in enumerate(rows):
        if i % 10 == 0:
            near = sorted((-int(q @ v), j) for m, (j, v) in enumerate(rows) if m != at)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread,most", [(0.05, 0.5), (0.5, 0.7), (50.0, None)])
def test_clustered_rows_are_sent_to_few_groups(spark, spread, most):
    table = clustered(spark, spread)
    is_query = F.col("vec_id") % 10 == 0
    found = neighbours.top_k(table, is_query, k=5, per_pivot=10)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == brute(table, 5)
    sent, groups = neighbours.replicas_per_row(table, is_query, k=5, per_pivot=10)
    assert groups == 12
    if most:
        assert sent < most * (groups - 1)


def test_empty_vectors_score_zero(spark):
    table = spark.createDataFrame([(0, []), (1, []), (2, [])], KIND)
    found = neighbours.top_k(table, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert neighbours.top_k(table, F.lit(False)).count() == 0
    alone = neighbours.top_k(table.where("vec_id = 0"), F.lit(True))
    assert alone.count() == 0


def test_copies_for_other_groups_are_not_held_in_python(spark):
    table = clustered(spark, 50.0)
    groups = neighbours.Groups(table, F.col("vec_id") % 10 == 0, 5, "vec_id", "embedding", 64, 10, 1024)
    assert "explode(cells" in groups.from_afar()._jdf.queryExecution().optimizedPlan().toString()
    batch = groups.placed.select("v", "cell").toPandas().iloc[list(range(1200)) * 2]
    slices = list(groups.within_reach(batch))
    assert sum(map(len, slices)) == 2400 and max(map(len, slices)) <= neighbours.ROWS_AT_ONCE
    assert groups.sent().agg(F.sum("n")).first()[0] == sum(s.sum() for s in slices) / 2
