"""Stall counters: how many loops in a row brought nothing new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_LOOPS = 10_000


def slice_of(loops: DataFrame, loop: str, loops_per_slice: int = SLICE_LOOPS) -> Column:
    """A coarse step of the loop axis: the day of a time, else ``loops_per_slice`` numbers."""
    kind = loops.schema[loop].dataType.simpleString()
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_date(F.to_date(loop)).cast("long")
    return F.floor(F.col(loop) / F.lit(loops_per_slice)).cast("long")


def stall_runs(loops: DataFrame, job: str, loop: str, new_rows: str, slices: Column | None = None) -> DataFrame:
    """Add ``stalled``: loops since the job last brought a row, this one included.

    ``loops`` is the aggregated table of one row per job and loop. The axis is cut into
    ``slices`` (any column that grows with ``loop``): counts run inside a slice, and what a slice
    takes over from those before it comes from one row per slice. So a job that holds most of
    the rows is spread over as many tasks as it has slices. A null job is a job; a null
    ``new_rows`` brought nothing.
    """
    cut = loops.withColumn("__slice", slices if slices is not None else slice_of(loops, loop))
    progress = F.coalesce(F.col(new_rows) > 0, F.lit(False))
    so_far = Window.partitionBy(job, "__slice").orderBy(loop).rowsBetween(Window.unboundedPreceding, 0)
    island = Window.partitionBy(job, "__slice", "__island").orderBy(loop)
    local = cut.withColumn("__island", F.count_if(progress).over(so_far)).withColumn("__n", F.row_number().over(island))
    # the row that opens an island is progress and counts 0; before the first one the slices before go on
    since = F.col("__n") - F.when(F.col("__island") > 0, 1).otherwise(0)
    ends = (
        local.groupBy(F.col(job).alias("__job"), F.col("__slice").alias("__at"))
        .agg(F.max(F.struct("__island", since.alias("since"))).alias("last"))
        .withColumn("__run", F.count_if(F.col("last.__island") > 0).over(Window.partitionBy("__job").orderBy("__at")))
    )
    total = F.sum("last.since").over(Window.partitionBy("__job", "__run").orderBy("__at"))
    carried = ends.withColumn("__end", total).select(
        "__job", "__at", F.coalesce(F.lag("__end").over(Window.partitionBy("__job").orderBy("__at")), F.lit(0)).alias("__carry")
    )
    joined = local.join(carried, F.col(job).eqNullSafe(F.col("__job")) & F.col("__slice").eqNullSafe(F.col("__at")))
    stalled = F.when(F.col("__island") > 0, since).otherwise(since + F.col("__carry"))
    return joined.select(*loops.columns, stalled.cast("int").alias("stalled"))
