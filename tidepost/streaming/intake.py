"""Incremental intake of landed files: dedup against all that came before, cap, resume."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidepost.operators.limits import first_rows
from tidepost.streaming.seen import first_of_new_keys
from tidepost.streaming.timed import timers

BATCH = "batch_id"


def landed(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    kind: str = "parquet",
    files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Stream over the files of a folder, in the order they landed."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


@dataclass
class Intake:
    """A sink of unique posts fed batch by batch.

    URLs seen before are remembered by the state store, so a batch costs its own rows, however much
    has been collected; nothing is late and nothing is forgotten. Each batch writes its own
    ``batch_id=`` folder and replaces it when Spark repeats the batch after a failure, with the
    state of that batch, so no row is lost or doubled. ``prepare`` turns landed rows into
    posts, row by row.
    """

    spark: SparkSession
    sink: str
    checkpoint: str
    schema: T.StructType
    order: Sequence[str]
    target: int | None = None
    url: str = "url"
    prepare: Callable[[DataFrame], DataFrame] | None = None

    def rows(self) -> DataFrame:
        """Collected rows, at most ``target`` of them in order of arrival."""
        stored = self._stored()
        if self.target is not None:
            stored = first_rows(stored, [BATCH, *self.order], self.target)
        return stored.drop(BATCH)

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.sink)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.sink).parquet(self.sink)

    def reached(self) -> bool:
        """Whether ``target`` rows are stored; the sink is counted once, then batch by batch."""
        if self.target is None:
            return False
        counts = self.__dict__.setdefault("_counts", None)
        if counts is None:
            counts = self._counts = {r[BATCH]: r["count"] for r in self._stored().groupBy(BATCH).count().collect()}
        return sum(list(counts.values())) >= self.target

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        # A committed batch never comes again, so its rows are kept even beyond the target.
        path = f"{self.sink}/{BATCH}={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        if getattr(self, "_counts", None) is not None:
            self._counts[batch_id] = self.spark.read.schema(self.schema).parquet(path).count()

    def start(self, stream: DataFrame) -> StreamingQuery:
        rows = self.prepare(stream) if self.prepare else stream
        with timers(self.spark):
            return (
                first_of_new_keys(rows, self.url, self.order)
                .writeStream.foreachBatch(self._take)
                .option("checkpointLocation", self.checkpoint)
                .trigger(availableNow=True)
                .start()
            )

    def run(self, stream: DataFrame, timeout: int | None = None) -> DataFrame:
        """Take everything that has landed, or stop once the target is reached.

        What was not taken yet is taken by the next run on the same checkpoint. There
        is no time limit unless one is given; passing it raises, never cuts the result.
        """
        query = self.start(stream)
        waited = 0
        while not query.awaitTermination(1):
            waited += 1
            if self.reached():
                query.stop()
                break
            if timeout is not None and waited >= timeout:
                query.stop()
                raise TimeoutError(f"intake did not finish in {timeout} s")
        return self.rows()


def run_to_table(
    stream: DataFrame, sink: str, checkpoint: str, timeout: int | None = None
) -> DataFrame:
    """Run an append-mode stream over all that has landed; give the sink's rows."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream did not finish in {timeout} s")
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(sink)
