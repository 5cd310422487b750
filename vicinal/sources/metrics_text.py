"""Metrics as text: lines of counters, histogram summaries and buckets, written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def report(counters: DataFrame) -> DataFrame:
    """value: a line "name value" for each row (name, n)."""
    return counters.select(F.format_string("%s %d", "name", "n").alias("value"))


def summary_lines(summaries: DataFrame) -> DataFrame:
    """value: a line for each row (name, n, mean, p50, p90, p99, p999, max)."""
    return summaries.select(F.format_string("hist_%s_ns count=%d mean=%d p50=%d p90=%d p99=%d p999=%d max=%d", "name", "n", "mean", "p50", "p90", "p99", "p999", "max").alias("value"))


def write_timeline(snapshots: DataFrame, path: str) -> None:
    """Add snapshots (label, sample, dt_s, counters and buckets as maps of text) to a timeline of JSON lines."""
    snapshots.write.mode("append").json(path)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots of a timeline."""
    kinds = "label string, sample bigint, dt_s double, counters map<string, bigint>, buckets map<string, map<string, bigint>>"
    return spark.read.schema(kinds).json(path)


def bucket_lines(histogram: DataFrame) -> DataFrame:
    """value: a line for each name with its buckets (name, bucket, n), in order."""
    each = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    text = F.array_join(F.transform(each, lambda b: F.format_string("b%d=%d", b["bucket"], b["n"])), " ")
    return histogram.groupBy("name").agg(F.concat(F.lit("buckets_"), F.first("name"), F.lit("_ns "), text).alias("value")).select("value")


def parse(lines: DataFrame) -> DataFrame:
    """kind, name, field, n of every number in the lines; a counter's field is null."""
    head = F.regexp_extract("value", r"^(\S+) ", 1)
    pairs = F.regexp_extract_all("value", F.lit(r"(\S+=-?\d+)"), 1)
    kind = F.when(head.startswith("hist_"), "summary").when(head.startswith("buckets_"), "bucket").otherwise("counter")
    name = F.regexp_replace(F.regexp_replace(head, "^(hist|buckets)_", ""), "_ns$", "")
    rows = lines.select(kind.alias("kind"), F.when(kind == "counter", head).otherwise(name).alias("name"), "value", pairs.alias("pairs"))
    counters = rows.filter("kind = 'counter'").select("kind", "name", F.lit(None).cast("string").alias("field"), F.regexp_extract("value", r" (-?\d+)$", 1).try_cast("bigint").alias("n"))
    others = rows.filter("kind <> 'counter'").select("kind", "name", F.explode("pairs").alias("x"))
    others = others.select("kind", "name", F.regexp_replace(F.substring_index("x", "=", 1), "^b(?=[0-9])", "").alias("field"), F.substring_index("x", "=", -1).cast("bigint").alias("n"))
    return counters.union(others)
