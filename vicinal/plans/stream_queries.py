"""Queries over streams, and over files that many tasks read: each gives what a batch query or plain SQL gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions import vectors
from vicinal.operators import scoring
from vicinal.plans import table_queries as t
from vicinal.plans import vector_queries as v
from vicinal.session import new_path, table, written
from vicinal.streaming import intake, metrics, score, state, topk

#: Files that the intake query's stream finds, and how many of them a batch may take.
FILES, TAKEN = 12, 5


def stream_topk_fold(spark, sf_dir):
    """The votes of ``knn_vote_score``, by a stream that folds the references in its own plan, block by block."""
    source = table(spark, sf_dir, "embeddings")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/embeddings.parque[t]")
    asked = stream.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), vectors.quantize(F.col("embedding")).alias("v"))
    path = new_path(spark, "scores")
    found = topk.score_blocks(asked, v.refs(spark, sf_dir))
    found.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(path)


def stream_metrics_report(spark, sf_dir):
    """Summaries and buckets of the events' values, by a stream that is stopped halfway and started again."""
    rows = _observations(spark, sf_dir)
    asked, path, checkpoint = (new_path(spark, name) for name in ("observations", "metrics", "stream"))
    for half in (0, 1):
        rows.filter(F.col("event_id") % 2 == half).select("name", "value").write.mode("append").parquet(asked)
        stream = spark.readStream.schema("name string, value bigint").parquet(asked)
        metrics.metrics_stream(stream, path, checkpoint).awaitTermination()
    return metrics.report(metrics.last_state(spark, path))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), F.floor(F.abs("value") * 100).cast("bigint").alias("value"))


def stream_score_metrics(spark, sf_dir):
    """A report on the requests that a stream scored: how many, rejected by reason, approved, and their votes."""
    asked, answers, path = (new_path(spark, name) for name in ("payloads", "answers", "metrics"))
    rows = t.requests(spark, sf_dir).select("q_id", "value")
    rows.write.parquet(asked)
    scored = score.score_stream(spark.readStream.schema(rows.schema).parquet(asked), scoring.payload_scorer(t.payload_index(spark, sf_dir)), answers, new_path(spark, "stream"))
    scored.awaitTermination()
    kinds = "q_id bigint, reason string, votes bigint, fraud_score double, approved boolean, response string, batch int"
    metrics.metrics_stream(metrics.of_answers(spark.readStream.schema(kinds).parquet(answers)), path, new_path(spark, "stream")).awaitTermination()
    return metrics.report(metrics.last_state(spark, path))


def stream_snapshot_rates(spark, sf_dir):
    """The rates of ``snapshot_rates``, by a stream that is started again for each third of the days and keeps the last snapshot of each instance."""
    rows = written(t._snapshots(spark, sf_dir).select("instance", *(F.col(c).cast("bigint").alias(c) for c in ("sec", "requests", "errors", "clicks"))), "snapshots")
    first, last = rows.agg(F.min("sec"), F.max("sec")).first()
    asked, path, checkpoint = (new_path(spark, name) for name in ("snapshots", "rates", "stream"))
    if first is None:
        return spark.createDataFrame([], "instance bigint, sec bigint, requests_delta bigint, errors_delta bigint, clicks_delta bigint, per_second double, errors_per_requests double, clicks_per_requests double")
    third = F.least(F.floor((F.col("sec") - first) * 3 / F.lit(last - first + 1)), F.lit(2))
    for part in range(3):
        rows.filter(third == part).write.mode("append").parquet(asked)
        found = state.rates(spark.readStream.schema(rows.schema).parquet(asked), ["instance"], "sec", "requests", ["errors", "clicks"])
        state.rate_stream(found, path, checkpoint).awaitTermination()
    back = spark.read.schema(found.schema).parquet(path)
    return back.select("instance", "sec", "requests_delta", "errors_delta", "clicks_delta", *(F.round(c, 8).alias(c) for c in ("per_second", "errors_per_requests", "clicks_per_requests")))


def stream_intake(spark, sf_dir):
    """event_type and its events as a bounded stream took them; batches is how many had rows, over how many took more files' rows than they may."""
    asked, path = new_path(spark, "events"), new_path(spark, "taken")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type").withColumn("file", F.pmod("event_id", F.lit(FILES)).cast("int"))
    rows.repartition(FILES, "file").write.partitionBy("file").parquet(asked)
    most = rows.groupBy("file").count().orderBy(F.desc("count")).limit(TAKEN).agg(F.sum("count")).first()[0] or 0
    listener = intake.Intake()
    spark.streams.addListener(listener)
    try:
        stream = intake.bounded(spark, asked, rows.schema, files=TAKEN)
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
        query.awaitTermination()
        taken = listener.taken(query)
    finally:
        spark.streams.removeListener(listener)
    counts = spark.read.schema(rows.schema).parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", "n", F.lit(len(taken)).cast("bigint").alias("batches"), F.lit(sum(x.rows > most for x in taken)).cast("bigint").alias("over"), F.lit(sum(x.rows for x in taken)).cast("bigint").alias("taken"))


QUERIES = {f.__name__: f for f in (stream_topk_fold, stream_metrics_report, stream_score_metrics, stream_snapshot_rates, stream_intake)}

_QUANTILES = ", ".join(f"{t._pow(p)} AS {name}" for name, p in metrics.SHARES.items())


def _lines(measured: str, counted: str = "") -> str:
    """The lines of a report, of a table m (name, value) and counters (name, n)."""
    return f"""WITH {measured}, h AS (SELECT name, CASE WHEN value = 0 THEN 0 ELSE length(bin(value)) END AS bucket, count(*) AS n FROM m GROUP BY ALL),
        c AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY name) AS total FROM h), q AS (SELECT name, {_QUANTILES} FROM c GROUP BY name),
        a AS (SELECT name, count(*) AS n, CAST(sum(value) // count(*) AS BIGINT) AS mean, max(value) AS most FROM m GROUP BY name)
        SELECT 'hist_' || name || '_ns count=' || n || ' mean=' || mean || ' p50=' || p50 || ' p90=' || p90 || ' p99=' || p99 || ' p999=' || p999 || ' max=' || most AS value FROM a JOIN q USING (name)
        UNION ALL SELECT 'buckets_' || name || '_ns ' || string_agg('b' || bucket || '=' || n, ' ' ORDER BY bucket) FROM h GROUP BY name {counted}"""


ORACLE_SQL = {
    "stream_topk_fold": v.ORACLE_SQL["knn_vote_score"],
    "stream_metrics_report": _lines("m AS (SELECT event_type AS name, CAST(floor(abs(value) * 100) AS BIGINT) AS value FROM events)"),
    "stream_score_metrics": _lines(
        f"{t._ANSWERS}, m AS (SELECT 'votes' AS name, coalesce(votes, 0) AS value FROM answers WHERE reason IS NULL)",
        """UNION ALL SELECT 'req_total ' || count(*) FROM answers HAVING count(*) > 0 UNION ALL SELECT 'req_rejected_' || reason || ' ' || count(*) FROM answers WHERE reason IS NOT NULL GROUP BY reason
        UNION ALL SELECT 'req_approved ' || count(*) FROM answers WHERE reason IS NULL AND coalesce(votes, 0) < 3 HAVING count(*) > 0""",
    ),
    "stream_snapshot_rates": t.ORACLE_SQL["snapshot_rates"],
    "stream_intake": f"""SELECT event_type, count(*) AS n, CAST(ceil((SELECT count(DISTINCT event_id % {FILES}) FROM events) / {TAKEN}) AS BIGINT) AS batches, CAST(0 AS BIGINT) AS over, (SELECT count(*) FROM events) AS taken
        FROM events GROUP BY event_type""",
}
