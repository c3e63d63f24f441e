"""Age filters for stored rows and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def retained(rows: DataFrame, ts: str, asof: Column, days: int = 3) -> DataFrame:
    """Rows not older than ``days`` at ``asof``."""
    return rows.where(F.col(ts) >= asof - F.make_dt_interval(F.lit(days)))


def expired_files(spark: SparkSession, path: str, asof: Column, days: int = 3) -> DataFrame:
    """``path, modified, size`` of files older than ``days``; only listings are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).where(
        F.col("modified") < asof - F.make_dt_interval(F.lit(days))
    )
