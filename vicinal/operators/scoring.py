"""Scoring requests end to end: parse, features, quantize, index search, vote, answer or reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators import evaluate, features, ivf, knn
from vicinal.operators.index import Index
from vicinal.session import written


def score_payloads(payloads: DataFrame, index: Index, mode: str = "exact", k: int = knn.K, cap: int = ivf.CAP, strict: bool = False) -> DataFrame:
    """q_id, reason, votes, fraud_score, approved, response of each of ``payloads`` (q_id, value).

    A rejected payload has a reason and no score; its response names the
    reason. Ids must be distinct. A reference with the id of a request is not
    its neighbour. Without any reference nobody votes and requests are approved.
    """
    asked = written(features.quantized(payloads.select("q_id", "value"), strict=strict).select("q_id", "reason", "v"), "requests")
    found = knn.vote(ivf.search(asked.filter("reason is null").select("q_id", "v"), index, mode, k, cap), k)
    out = asked.select("q_id", "reason").join(found, "q_id", "left")
    valid = F.col("reason").isNull()
    out = out.select(
        "q_id", "reason", F.when(valid, F.coalesce("votes", F.lit(0))).alias("votes"), F.when(valid, F.coalesce("fraud_score", F.lit(0.0))).alias("fraud_score"),
        F.when(valid, F.coalesce("approved", F.lit(True))).alias("approved"),
    )
    answer = F.when(valid, F.to_json(F.struct("approved", "fraud_score"))).otherwise(F.to_json(F.struct(F.col("reason").alias("error"))))
    return out.withColumn("response", answer)


def payload_scorer(index: Index, **settings) -> Callable[[DataFrame], DataFrame]:
    """Answers for a batch of requests (q_id, value), for ``streaming.score.score_stream``."""
    return lambda payloads: score_payloads(payloads, index, **settings)


def evaluate_corpus(entries: DataFrame, index: Index, **settings) -> DataFrame:
    """The counts of ``evaluate.confusion`` for entries (q_id, value, expected_approved) of a labelled corpus; a rejected one is an error."""
    answers = score_payloads(entries, index, **settings)
    return evaluate.confusion(entries.select("q_id", "expected_approved").join(answers.select("q_id", "approved"), "q_id"))
