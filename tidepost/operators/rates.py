"""Request rate over a trailing interval, and its level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.functions.dates import rate_color, rate_level, rate_percent
from tidepost.functions.fixed_values import RATE_DANGER, RATE_LIMIT, RATE_WARNING
from tidepost.operators.running import running_total

SECOND = 1_000_000
DAY = 86_400 * SECOND


def trailing_counts(
    requests: DataFrame, ts: str = "ts", seconds: int = 60, keys: Sequence[str] = ()
) -> DataFrame:
    """``keys, ts, requests``: requests in ``(ts - seconds, ts]`` at each distinct time.

    A request enters at its time and leaves ``seconds`` later; the rate is the
    running balance. Requests are counted per distinct time before anything is
    ordered, so a burst on one instant stays one row per map task.
    """
    keys = list(keys)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    entered = requests.groupBy(*keys, at.alias("__at")).agg(F.count("*").alias("__n"))
    change = F.explode(
        F.array(
            F.struct(F.col("__at").alias("at"), F.col("__n").alias("change"), F.col("__n").alias("n")),
            F.struct(
                (F.col("__at") + seconds * SECOND).alias("at"),
                (-F.col("__n")).alias("change"),
                F.lit(0).cast("bigint").alias("n"),
            ),
        )
    )
    balance = (
        entered.select(*keys, change.alias("c"))
        .groupBy(*keys, F.col("c.at").alias("__at"))
        .agg(F.sum("c.change").alias("__change"), F.sum("c.n").alias("__new"))
    )
    totals = running_total(
        balance, "__at", "__change", "requests", fine=SECOND, coarse=DAY, keys=keys
    )
    return totals.where(F.col("__new") > 0).select(
        *keys, F.timestamp_micros("__at").alias(ts), "requests"
    )


def rate_status(
    requests: DataFrame,
    ts: str = "ts",
    seconds: int = 60,
    limit: int = RATE_LIMIT,
    warning: int = RATE_WARNING,
    danger: int = RATE_DANGER,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rate, level, colour and percent of the limit at every time with a request."""
    n = F.col("requests")
    return trailing_counts(requests, ts, seconds, keys).withColumns(
        {
            "status": rate_level(n, warning, danger),
            "color": rate_color(n, warning, danger),
            "percent": rate_percent(n, limit),
        }
    )
