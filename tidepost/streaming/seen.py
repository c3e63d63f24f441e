"""New keys of an unbounded stream: a state store remembers every key, so a batch costs its own rows only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Times keep their microseconds while a row is packed.
PACKED = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


class FirstOfKey(StatefulProcessor):
    """Gives the first row (by ``rank``) of a key the first time the key comes, and none ever after."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for batch in rows:
            found = min(zip(batch["rank"].tolist(), batch["packed"].tolist()))
            best = found if best is None else min(best, found)
        fresh = [] if best is None or self.seen.exists() else [(*key, best[1])]
        if fresh:
            self.seen.update((True,))
        yield pd.DataFrame(fresh, columns=["key", "packed"], dtype=object)

    def close(self) -> None:
        pass


def _sortable(column: Column, data_type) -> Column:
    """Text that sorts as a whole number, a time or a text does; null last."""
    kind = data_type.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        # shifted to be positive, then padded
        text = F.lpad((column.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    elif kind.startswith("timestamp") or kind == "date":
        text = F.date_format(column, "yyyyyy-MM-dd HH:mm:ss.SSSSSS")
    elif kind == "string":
        text = column
    else:
        raise TypeError(f"rows can't be ordered by {kind} here")
    return F.coalesce(F.concat(F.lit("0"), text), F.lit("1"))


def first_of_new_keys(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of each value of ``key`` that no earlier batch had, the first row of this batch in ``order``.

    Rows with a null or empty key are left out. Nothing is ever late and no key is
    forgotten: the state holds one flag per key on disk (RocksDB, see ``timed.timers``), and a batch
    reads and writes the keys it holds, however many there are in all. ``order`` may hold whole
    numbers, times and texts.
    """
    schema = rows.schema
    rank = F.concat_ws("\0", *[_sortable(F.col(c), schema[c].dataType) for c in order])
    packed = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), PACKED)
    slim = rows.where(F.coalesce(F.col(key), F.lit("")) != "").select(F.col(key).alias("key"), rank.alias("rank"), packed.alias("packed"))
    found = slim.groupBy("key").transformWithStateInPandas(FirstOfKey(), "key string, packed string", "Append", "None")
    return found.select(F.from_json("packed", schema, PACKED).alias("row")).select("row.*")
