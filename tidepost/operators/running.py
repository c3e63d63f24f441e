"""Running totals over a long axis without a single-task window.

The axis is cut into coarse and fine slices. Totals of coarse slices are summed
first, then fine slices inside a coarse one, then rows inside a fine one, so
every window partition is bounded by the slice widths, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    points: DataFrame,
    axis: str,
    value: str,
    out: str,
    fine: int,
    coarse: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all points of the key up to this one.

    ``axis`` is an integer column, unique per key; ``coarse`` must be a multiple
    of ``fine``. Points must already be aggregated to distinct axis values.
    """
    if coarse % fine:
        raise ValueError("coarse must be a multiple of fine")
    keys = list(keys)
    axis_col = F.col(axis)

    def slice_of(width: int):
        return axis_col - F.pmod(axis_col, F.lit(width))

    sliced = points.withColumns({"__fine": slice_of(fine), "__coarse": slice_of(coarse)})
    fine_sums = sliced.groupBy(*keys, "__coarse", "__fine").agg(F.sum(value).alias("__sum"))
    coarse_sums = fine_sums.groupBy(*keys, "__coarse").agg(F.sum("__sum").alias("__csum"))

    def before(order: str, *partition: str):
        return (
            Window.partitionBy(*partition)
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    one_key = keys or [F.lit(0)]
    coarse_open = coarse_sums.select(
        *keys,
        "__coarse",
        F.coalesce(F.sum("__csum").over(before("__coarse", *one_key)), F.lit(0)).alias("__copen"),
    )
    fine_open = (
        fine_sums.withColumn(
            "__fopen",
            F.coalesce(F.sum("__sum").over(before("__fine", *keys, "__coarse")), F.lit(0)),
        )
        .join(coarse_open, [*keys, "__coarse"])
        .select(*keys, "__fine", (F.col("__copen") + F.col("__fopen")).alias("__open"))
    )
    inside = (
        Window.partitionBy(*keys, "__fine")
        .orderBy(axis)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        sliced.withColumn("__inside", F.sum(value).over(inside))
        .join(fine_open, [*keys, "__fine"])
        .withColumn(out, F.col("__open") + F.col("__inside"))
        .select(*points.columns, out)
    )
