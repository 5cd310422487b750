"""Bounded intake: how much a micro-batch takes, and what it took.

A file stream takes at most a number of files, or of bytes, a trigger; the rest
waits in its folder, so a scorer that falls behind does not fill memory. A
listener gathers what the batches took, of the last ``KEPT`` only.
"""

from __future__ import annotations

import threading
from collections import deque
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

KEPT = 10_000


def bounded(spark: SparkSession, path: str, schema: StructType, files: int | None = None, size: int | None = None) -> DataFrame:
    """A stream of the Parquet files below ``path`` that takes at most ``files`` of them, or about ``size`` bytes, a trigger."""
    if (files is None) == (size is None):
        raise ValueError("bound the files or the bytes of a trigger")
    name, most = ("maxFilesPerTrigger", files) if files is not None else ("maxBytesPerTrigger", size)
    return spark.readStream.schema(schema).option(name, most).parquet(path)


class Taken(NamedTuple):
    """What a batch took, and how long it did, in milliseconds."""

    batch: int
    rows: int
    took_ms: int


class Intake(StreamingQueryListener):
    """The batches of one query, by the progress that it reports."""

    def __init__(self) -> None:
        self._batches: dict[str, deque[Taken]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _of(self, run: str) -> tuple[deque[Taken], threading.Event]:
        with self._lock:
            return self._batches.setdefault(run, deque(maxlen=KEPT)), self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802 (names of the interface)
        self._of(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._of(str(p.runId))[0].append(Taken(p.batchId, p.numInputRows, p.batchDuration))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._of(str(event.runId))[1].set()

    def taken(self, query: StreamingQuery, wait: float = 60) -> list[Taken]:
        """Of a query that has ended, its batches with rows, in order; the listener hears of the end after its progress."""
        batches, ended = self._of(str(query.runId))
        if not ended.wait(wait):
            raise TimeoutError("the listener was not told that the query ended")
        return sorted(t for t in batches if t.rows)
