"""The intake's memory: a batch costs its own rows; what is repeated after a failure is neither lost nor doubled."""

import datetime as dt

import pytest

from tidepost.streaming.intake import Intake, landed

KIND = "post_id long, url string, at timestamp, note string, score double, tags array<string>"
START = dt.datetime(2026, 1, 1, microsecond=123456)


def row(i, url):
    return (i, url, START + dt.timedelta(seconds=abs(i or 0) % 1000), None if i and i % 2 else "é\n\"", 0.1, ["a", None])


def land(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([], KIND).schema


def test_rows_pass_unchanged_and_the_first_in_order_stays(spark, tmp_path, schema):
    rows = [row(5, "a"), row(-3, "a"), row(10**15, "a"), row(None, "b"), row(7, "b"), row(8, None), row(9, ""), row(2, "c"), row(2, "c")]
    land(spark, tmp_path / "in", [rows])
    intake = Intake(spark, f"{tmp_path}/sink", f"{tmp_path}/state", schema, ["post_id", "at"])
    found = intake.run(landed(spark, f"{tmp_path}/in", schema))
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in spark.createDataFrame([row(-3, "a"), row(7, "b"), row(2, "c")], schema).collect())
    assert found.schema == schema


def test_a_batch_reads_its_own_rows_only(spark, tmp_path, schema):
    """Input of each batch is its file; the sink that grows is not read."""
    land(spark, tmp_path / "in", [[row(i * 3 + k, f"u{i * 2 + k}") for k in range(3)] for i in range(20)])
    intake = Intake(spark, f"{tmp_path}/sink", f"{tmp_path}/state", schema, ["post_id"])
    intake._stored = None  # reading the sink while batches run would fail
    query = intake.start(landed(spark, f"{tmp_path}/in", schema, files_per_trigger=1))
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert read == [3] * 20
    del intake.__dict__["_stored"]
    assert sorted(r.url for r in intake.rows().collect()) == sorted(f"u{k}" for k in range(41))


def test_a_batch_that_failed_half_way_is_repeated_whole(spark, tmp_path, schema):
    land(spark, tmp_path / "in", [[row(1, "a"), row(2, "b")], [row(3, "b"), row(4, "c"), row(5, "d")]])
    intake = Intake(spark, f"{tmp_path}/sink", f"{tmp_path}/state", schema, ["post_id"])
    take = intake._take

    def half(batch, batch_id):
        if batch_id == 1:
            batch.limit(1).write.mode("overwrite").parquet(f"{intake.sink}/batch_id=1")
            raise RuntimeError("stopped half-way")
        take(batch, batch_id)

    intake._take = half
    with pytest.raises(Exception, match="half-way"):
        intake.run(landed(spark, f"{tmp_path}/in", schema, files_per_trigger=1))
    intake._take = take
    found = intake.run(landed(spark, f"{tmp_path}/in", schema, files_per_trigger=1))
    assert sorted((r.post_id, r.url) for r in found.collect()) == [(1, "a"), (2, "b"), (4, "c"), (5, "d")]
