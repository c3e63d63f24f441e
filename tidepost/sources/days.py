"""Posts stored by day, so that a job reads the files of the days its work items ask for.

A span of many days is stored with several days in a folder (``days``), as every folder costs the
driver memory and the writer a file, however few posts it holds.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "day"
#: Most folders that ``days_per_folder`` aims at.
MOST_FOLDERS = 512


def days_per_folder(first: str, after: str, most: int = MOST_FOLDERS) -> int:
    """Days in a folder so that the days from ``first`` to before ``after`` need ``most`` folders, or one more."""
    return max(1, -(-(date.fromisoformat(after) - date.fromisoformat(first)).days // most))


def _folder(day: Column, days: int) -> Column:
    """First day of the folder that holds ``day``."""
    return day if days == 1 else F.date_from_unix_date((F.floor(F.unix_date(day) / days) * days).cast("int"))


def write_by_day(posts: DataFrame, path: str, ts: str = "ts", tasks_per_day: int = 1, days: int = 1) -> None:
    """One folder per ``days`` days of ``ts``, named by the first; posts without a time go to the folder of null.

    Rows of a folder go through ``tasks_per_day`` tasks, each of which writes one file of it.
    """
    part = F.pmod(F.xxhash64(*[f.name for f in posts.schema if not isinstance(f.dataType, T.MapType)]), F.lit(tasks_per_day))
    dated = posts.withColumn(DAY, _folder(F.to_date(ts), days))
    dated.repartition(DAY, part).write.partitionBy(DAY).parquet(path)


def read_days(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Posts written by ``write_by_day``, with the column ``day`` of their folder."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])).parquet(path)


def in_days_of(posts: DataFrame, items: DataFrame, undated: bool = False, days: int = 1, ts: str = "ts") -> DataFrame:
    """``posts`` of the days that dated work items cover, without the column ``day``.

    The days of the items are a small table, from which Spark prunes the folders before it
    reads (dynamic partition pruning). With ``undated``, an item without readable dates asks for
    every day, so nothing is pruned. ``days`` and ``ts`` are those the posts were written with; of a folder of
    several days only the posts of days asked for are left.
    """
    if undated:
        return posts.drop(DAY)
    first, last = F.col("chunk_start").try_cast("date"), F.col("chunk_end").try_cast("date")
    ranges = items.where(first < last).select(first.alias("first"), last.alias("last")).distinct()
    asked = ranges.select(F.explode(F.sequence("first", F.date_sub("last", 1))).alias("__day")).distinct()
    asked = asked.select(_folder(F.col("__day"), days).alias(DAY), "__day")
    # Spark prunes folders only by a broadcast side; distinct days of a calendar are few, whatever the plan holds.
    if days == 1:
        return posts.join(F.broadcast(asked.drop("__day")), DAY, "left_semi").drop(DAY)
    return posts.withColumn("__day", F.to_date(ts)).join(F.broadcast(asked), [DAY, "__day"], "left_semi").drop(DAY, "__day")
