"""Progress ledger of a job: one row per finished work item, appended only.

Replaces a state file that is rewritten as a whole: finishing an item costs one
small append, and resuming is an anti join that also fills gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("work_idx", T.LongType()),
        T.StructField("fetched", T.LongType()),
        T.StructField("new_unique", T.LongType()),
        T.StructField("saved_at", T.TimestampType()),
        T.StructField("deleted", T.BooleanType()),
        # grows by one whenever the job is forgotten; rows of an older one don't count
        T.StructField("generation", T.LongType()),
    ]
)


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        if not self._stored():
            spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)

    def _stored(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return system.exists(folder) and len(system.listStatus(folder)) > 0

    def _append(self, rows: DataFrame) -> None:
        stamped = rows.withColumn("saved_at", F.current_timestamp())
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER]
        stamped.select(*columns).write.mode("append").parquet(self.path)

    def _rows(self, job_id: str) -> DataFrame:
        rows = self.spark.read.schema(LEDGER).parquet(self.path).where(F.col("job_id") == job_id)
        return rows.withColumn("generation", F.coalesce("generation", F.lit(0)))

    def _generation(self, job_id: str) -> int:
        """How often the job was forgotten; no clock of any session matters."""
        return self._rows(job_id).where("deleted").agg(F.max("generation")).first()[0] or 0

    def save(self, job_id: str, finished: DataFrame) -> None:
        """Record finished items (``work_idx, fetched, new_unique``)."""
        columns = {"job_id": F.lit(job_id), "deleted": F.lit(False), "generation": F.lit(self._generation(job_id))}
        self._append(finished.withColumns(columns))

    def delete(self, job_id: str) -> None:
        """Forget a job: rows saved up to now no longer count."""
        row = self.spark.range(1).select(
            F.lit(job_id).alias("job_id"),
            F.lit(None).alias("work_idx"),
            F.lit(0).alias("fetched"),
            F.lit(0).alias("new_unique"),
            F.lit(True).alias("deleted"),
            F.lit(self._generation(job_id) + 1).alias("generation"),
        )
        self._append(row)

    def load(self, job_id: str) -> DataFrame:
        """Finished items of a job, one row each."""
        rows = self._rows(job_id)
        now = rows.where("deleted").agg(F.max("generation")).scalar()
        return (
            rows.where(~F.col("deleted"))
            .where(F.col("generation") == F.coalesce(now, F.lit(0)))
            .groupBy("work_idx")
            .agg(F.max("fetched").alias("fetched"), F.max("new_unique").alias("new_unique"))
        )

    def exists(self, job_id: str) -> bool:
        return bool(self.load(job_id).limit(1).count())

    def highest(self, job_id: str) -> DataFrame:
        """One row ``highest``: largest finished index, for display only."""
        return self.load(job_id).agg(F.max("work_idx").alias("highest"))
