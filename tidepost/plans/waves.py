"""Work items in waves: what a wave may ask follows from what the waves before it brought.

Matching does not depend on quotas and runs once. Each wave is a job of its own over its
items' candidates; its new rows are written to a folder of the wave, which is the ledger:
a run that stops goes on with the first wave that has none, and gives what one run would.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidepost.operators.limits import quota_per_group
from tidepost.plans.work import first_matches

# Items at work at a time, least rows asked of one.
WORKERS = 3
LEAST = 50


def wave_quota(target: int, collected: int, items_left: int, least: int = LEAST) -> int:
    """Rows to ask of each item of the next wave; 0 once the target is reached."""
    rest = target - collected
    return 0 if rest <= 0 else max(least, math.ceil(rest / max(1, items_left)))


def _done(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def run_waves(
    candidates: DataFrame,
    items: int,
    target: int,
    folder: str,
    order: Sequence[str],
    workers: int = WORKERS,
    least: int = LEAST,
    url: str = "url",
    most_waves: int | None = None,
) -> DataFrame:
    """Rows of ``candidates`` that the waves collect, with ``wave``; at least ``target`` of them if there are.

    ``candidates`` has ``work_idx`` from 0 to ``items - 1``, ``url`` and the columns of ``order``; store it,
    as each wave reads its part. A wave asks every item for its first ``wave_quota`` rows and
    keeps of each URL the match of the earliest item, unless an earlier wave has it. Rows
    without a URL count as asked but are not kept. ``most_waves`` stops early; the next call
    on the same ``folder`` goes on. The join against earlier waves reads about ``target`` rows at most.
    """
    spark = candidates.sparkSession
    schema = candidates.schema
    collected, ran = 0, 0
    waves = -(-items // workers)
    paths: list[str] = []
    for wave in range(waves):
        path = f"{folder}/wave={wave}"
        if not _done(spark, path):
            if most_waves is not None and ran >= most_waves:
                break
            quota = wave_quota(target, collected, items - wave * workers, least)
            if quota == 0:
                break
            own = candidates.where(F.col("work_idx").between(wave * workers, (wave + 1) * workers - 1))
            fresh = first_matches(quota_per_group(own, "work_idx", order, quota), list(order), url)
            if paths:
                fresh = fresh.join(spark.read.schema(schema).parquet(*paths).select(url), url, "left_anti").select(*schema.names)
            fresh.write.mode("overwrite").parquet(path)
            ran += 1
        paths.append(path)
        collected += spark.read.schema(schema).parquet(path).count()
    if not paths:
        return spark.createDataFrame([], schema).withColumn("wave", F.lit(None).cast("int"))
    return spark.read.schema(StructType([*schema.fields, StructField("wave", IntegerType())])).option("basePath", folder).parquet(*paths)
