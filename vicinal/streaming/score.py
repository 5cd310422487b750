"""Scoring a stream of requests against a static reference table.

Each micro-batch runs the batch plan: top-k needs a window over all candidates
of a request, which a stream itself does not allow. Requests are independent,
so there is no state, no watermark and no order to keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vicinal.operators import knn


def scorer(refs: DataFrame, k: int = knn.K) -> Callable[[DataFrame], DataFrame]:
    """Votes for a batch of queries (q_id, v)."""
    return lambda queries: knn.vote(knn.brute_force(queries, refs, k), k)


def score_stream(queries: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start scoring a streaming table of queries into Parquet below ``path``.

    A batch that is run again after a failure replaces its own folder, so each
    request is answered once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        score(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
