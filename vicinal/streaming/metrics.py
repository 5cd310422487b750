"""Metrics of a running stream: counters and log2 histograms as the state of a streaming aggregate.

Observations are rows (name, value); a null value counts and nothing else. The
state has a row a name and bucket, at most 65 a name, whatever the input; each
micro-batch combines its own rows before they meet the state. It is kept by
Spark's checkpoint, so a stream that is stopped and started again, or loses an
executor, goes on from where it was. After every batch the whole state is
written; a report is made from the last one, and of those before ``KEPT`` stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinal.functions import scalars
from vicinal.operators import evaluate
from vicinal.session import remove
from vicinal.sources import metrics_text

#: States that stay, so that a report may still read the one before the last.
KEPT = 3
SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def observed(observations: DataFrame) -> DataFrame:
    """name, bucket, n, total, most of observations (name, value), of a stream or a table; the bucket of a null value is null."""
    bucket = scalars.log2_bucket(F.col("value")).alias("bucket")
    return observations.groupBy("name", bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))


def metrics_stream(observations: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start keeping the state of a stream of observations; each batch writes it below ``path``, in a folder that a rerun replaces."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number >= KEPT:
            remove(rows.sparkSession, f"{path}/batch={number - KEPT}")

    writer = observed(observations).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def last_state(spark: SparkSession, path: str) -> DataFrame:
    """name, bucket, n, total, most after the last batch."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == F.lit(last)).drop("batch")


def counters(state: DataFrame) -> DataFrame:
    """name, n of what was only counted."""
    return state.filter("bucket is null").select("name", "n")


def summaries(state: DataFrame) -> DataFrame:
    """name, n, mean (integer), p50, p90, p99, p999 (from the buckets), max of what was measured."""
    own = state.filter("bucket is not null")
    whole = own.groupBy("name").agg(F.sum("n").alias("n"), F.floor(F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).cast("bigint").alias("mean"), F.max("most").alias("max"))
    return whole.join(evaluate.histogram_quantile(own.select("name", "bucket", "n"), ["name"], SHARES), "name")


def report(state: DataFrame) -> DataFrame:
    """value: the lines of a metrics report, as ``metrics_text`` writes them."""
    lines = metrics_text.report(counters(state)).union(metrics_text.summary_lines(summaries(state)))
    return lines.union(metrics_text.bucket_lines(state.filter("bucket is not null").select("name", "bucket", "n")))


def of_answers(answers: DataFrame) -> DataFrame:
    """Observations of scored requests (reason, votes, approved): all, those rejected by reason, those approved, and the votes."""
    count = lambda name: F.struct(name.alias("name"), F.lit(None).cast("bigint").alias("value"))
    each = F.array(
        count(F.lit("req_total")),
        count(F.when(F.col("reason").isNotNull(), F.concat(F.lit("req_rejected_"), "reason"))),
        count(F.when(F.col("approved"), F.lit("req_approved"))),
        F.struct(F.when(F.col("votes").isNotNull(), F.lit("votes")).alias("name"), F.col("votes").cast("bigint").alias("value")),
    )
    return answers.select(F.explode(each).alias("o")).select("o.*").filter("name is not null")
