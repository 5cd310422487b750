"""Rates of counters from a stream of snapshots: the last snapshot of every instance is keyed state.

The state is a row an instance. Snapshots of an instance are taken in the order
of their time; one that is not later than the last is left out, so a snapshot
that arrives twice counts once. Those of one batch are sorted first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rates(StatefulProcessor):
    """Deltas of counters, the total's per second, and each part's ratio to the total; null where there is no snapshot before."""

    def __init__(self, out: list[str], order: str, total: str, parts: list[str]) -> None:
        self.out, self.columns, self.parts = out, [order, total, *parts], parts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ", ".join(f"`{c}` bigint" for c in self.columns))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803 (names of the interface)
        before = tuple(self.last.get()) if self.last.exists() else None
        for now in sorted(tuple(r[c] for c in self.columns) for r in rows):
            if before is not None and now[0] <= before[0]:
                continue
            yield Row(**dict(zip(self.out, (*key, now[0], *self._since(before, now)), strict=True)))
            before = now
        if before is not None:
            self.last.update(before)

    def _since(self, before: tuple[int, ...] | None, now: tuple[int, ...]) -> list[float | None]:
        if before is None:
            return [None] * (2 * len(self.parts) + 2)
        seconds, each, *others = (a - b for a, b in zip(now, before, strict=True))
        return [each, *others, each / seconds, *(x / each if each > 0 else 0.0 for x in others)]

    def close(self) -> None:
        pass


def rates(snapshots: DataFrame, by: list[str], order: str, total: str, parts: list[str]) -> DataFrame:
    """The columns of ``evaluate.rates``, for a stream of snapshots (by, order in seconds, counters as integers)."""
    out = StructType([snapshots.schema[c] for c in by]).add(order, LongType())
    for c in (total, *parts):
        out = out.add(f"{c}_delta", LongType())
    for c in ("per_second", *(f"{c}_per_{total}" for c in parts)):
        out = out.add(c, DoubleType())
    rows = snapshots.select(*by, *(snapshots[c].cast("bigint").alias(c) for c in (order, total, *parts)))
    return rows.groupBy(*by).transformWithState(Rates(out.names, order, total, parts), out, outputMode="Append", timeMode="None")


def rate_stream(found: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start writing the rows of ``rates``; keyed state needs the state store that is named here, which the query keeps."""
    conf = found.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
