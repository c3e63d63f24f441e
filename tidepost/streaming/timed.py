"""A stateful operator with timers: silent jobs are reported while they are silent.

It keeps a few values per job and acts when the watermark passes a time, not when the next row
happens to come. Files per trigger, batches and the order of rows within them change
nothing. It needs the RocksDB state store (see ``timers``).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def timers(spark: SparkSession):
    """While open, queries that start keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


#: In place of a job's next loop: it is taken to have ended.
GIVEN_UP = -(1 << 62)


class SilenceClock(StatefulProcessor):
    """Settles a job's loops one by one as the watermark passes their ends."""

    def __init__(self, loop_seconds: int, give_up: int):
        self.step, self.give_up = loop_seconds, give_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "next bigint, last bigint")
        self.waiting = handle.getMapState("waiting", "loop bigint", "new_rows bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for loop, new_rows in zip(batch["loop"].tolist(), batch["new_rows"].tolist()):
                self.waiting.updateValue((loop,), (new_rows,))
                first = loop if first is None else min(first, loop)
        held = self.clock.get() if self.clock.exists() else (GIVEN_UP, None)
        if first is not None and held[0] == GIVEN_UP:
            self.clock.update((first, held[1]))
            self.handle.registerTimer((first + self.step) * 1000)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        out = []
        loop, last = self.clock.get()
        while (loop + self.step) * 1000 <= mark:
            if self.waiting.containsKey((loop,)):
                gap = 0 if last is None else (loop - last) // self.step - 1
                out.append((loop, self.waiting.getValue((loop,))[0], gap))
                self.waiting.removeKey((loop,))
                last = loop
            elif (loop - last) // self.step <= self.give_up:
                out.append((loop, 0, (loop - last) // self.step))
            else:
                # given up: nothing is due before the job's next row
                known = [k[0] for k in self.waiting.keys()]
                if not known:
                    self.clock.update((GIVEN_UP, last))
                    yield self._frame(key, out)
                    return
                loop = min(known) - self.step
            loop += self.step
        self.clock.update((loop, last))
        self.handle.registerTimer((loop + self.step) * 1000)
        yield self._frame(key, out)

    def _frame(self, key, out) -> pd.DataFrame:
        found = pd.DataFrame([(key[0], *row) for row in out], columns=["job", "loop", "new_rows", "stalled"])
        return found.astype({"job": object, "loop": "int64", "new_rows": "int64", "stalled": "int64"})

    def close(self) -> None:
        pass


def silences(loops: DataFrame, loop_seconds: int = 60, give_up: int = 15) -> DataFrame:
    """``job, loop, new_rows, stalled`` of every finished loop of every job, those without a row too.

    ``loops`` is the stream of :func:`loop_counts`. A loop without a row has ``new_rows`` 0 and is
    reported as soon as the watermark passes its end; ``stalled`` then counts the loops since
    the last row. A loop with rows tells how many passed without one before it. After
    ``give_up`` silent loops a job is taken to have ended, until its next row.
    """
    kind = loops.schema["job"].dataType.simpleString()
    return loops.groupBy("job").transformWithStateInPandas(
        SilenceClock(loop_seconds, give_up), f"job {kind}, loop bigint, new_rows bigint, stalled bigint", "Append", "EventTime"
    )
