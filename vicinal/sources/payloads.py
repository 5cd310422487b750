"""Request payloads: files of JSON arrays or lines, test corpora with expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.sources.arrays import read_objects


def slices(texts: DataFrame, column: str = "value") -> DataFrame:
    """``texts`` of JSON arrays with one row an element: its place ``pos`` and its text ``payload``."""
    elements = F.from_json(column, "array<string>")
    return texts.select("*", F.posexplode(elements).alias("pos", "payload"))


def read_payload_array(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, value: the objects of files that hold one JSON array each; a large file is read by many tasks."""
    return read_objects(spark, path)


def read_payload_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: one payload a line."""
    return spark.read.text(path)


ENTRY = "request string, expected_approved boolean, expected_fraud_score double"


def read_corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """value, expected_approved, expected_fraud_score: the entries of a labelled test corpus.

    The corpus is one object a file with its ``entries``, or with ``lines`` an
    entry a line. Either way a large file is read by many tasks. In the first
    form the entries are the objects at the second level that have a request.
    """
    texts = spark.read.text(path) if lines else read_objects(spark, path, 2)
    found = texts.select(F.explode(F.array(F.from_json("value", ENTRY))).alias("e"))
    return (found if lines else found.filter("e.request is not null")).select(F.col("e.request").alias("value"), "e.expected_approved", "e.expected_fraud_score")


def write_corpus(entries: DataFrame, path: str) -> None:
    """Entries (value, expected_approved, expected_fraud_score) as JSON lines; ``value`` may be called ``request`` already."""
    names = {"value": "request"} if "request" not in entries.columns else {}
    entries.withColumnsRenamed(names).write.mode("overwrite").json(path)
