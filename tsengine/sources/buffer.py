"""Single points gathered into writes: a store is given a batch when enough points wait, or when they have waited."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame

from ..model import SAMPLE_SCHEMA
from .store import Store

FLUSH_POINTS, FLUSH_SECONDS = 10_000, 5


class WriteBuffer:
    """At most points samples on the driver; `waiting` shows them to queries until they are written."""

    def __init__(self, store: Store, points: int = FLUSH_POINTS, seconds: float = FLUSH_SECONDS, clock=time.time, number=time.time_ns):
        self.store, self.points, self.seconds, self.clock, self.number = store, points, seconds, clock, number
        self._held: list[tuple] = []
        self._since, self._lock = clock(), threading.Lock()

    def add(self, rows: list[tuple]) -> int:
        """Take (name, labels, ts, value) rows; what exceeds the bound is written in batches of it. The points taken."""
        with self._lock:
            if not self._held:
                self._since = self.clock()
            self._held.extend(rows)
            while len(self._held) >= self.points:
                self._write(self._held[: self.points])
                del self._held[: self.points]
            if self._held and self.clock() - self._since >= self.seconds:
                self._write(self._held)
                self._held = []
        return len(rows)

    def flush(self) -> None:
        with self._lock:
            if self._held:
                self._write(self._held)
                self._held = []

    def _frame(self, rows: list[tuple]) -> DataFrame:
        return self.store.spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"{SAMPLE_SCHEMA}, arrival long")

    def _write(self, rows: list[tuple]) -> None:
        self.store.write(self._frame(rows), self.number())
        self._since = self.clock()

    def waiting(self) -> DataFrame:
        with self._lock:
            return self._frame(list(self._held)).drop("arrival")

    def __len__(self) -> int:
        return len(self._held)
