"""Heartbeat of running streams: progress rows, at most one per interval."""

from __future__ import annotations

import json
import time

from pyspark.sql.streaming import StreamingQueryListener


class Heartbeat(StreamingQueryListener):
    """Keeps the newest progress of each stream and passes a line on per interval."""

    def __init__(self, emit=print, seconds: float = 60.0, clock=time.monotonic):
        self.emit = emit
        self.seconds = seconds
        self.clock = clock
        self.latest: dict[str, dict] = {}
        self._sent: dict[str, float] = {}

    def onQueryStarted(self, event):
        self._sent.setdefault(str(event.id), self.clock())

    def onQueryProgress(self, event):
        progress = event.progress
        key = str(progress.id)
        total = self.latest.get(key, {}).get("total_rows", 0) + progress.numInputRows
        self.latest[key] = {
            "query": key,
            "batch_id": progress.batchId,
            "timestamp": progress.timestamp,
            "new_rows": progress.numInputRows,
            "total_rows": total,
        }
        now = self.clock()
        if now - self._sent.get(key, now) >= self.seconds:
            self._sent[key] = now
            self.emit(json.dumps(self.latest[key]))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._sent.pop(str(event.id), None)
