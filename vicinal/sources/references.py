"""Labelled reference vectors in JSON: an array of {"vector": [...], "label": "fraud" | "legit"}, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.sources.blocks import numbered, read_blocks

SCHEMA = "vector array<float>, label string"


def read_references(spark: SparkSession, path: str, dims: int | None = 14, keep_bad: bool = False) -> DataFrame:
    """ref_id, v, is_fraud of each well-formed record; ref_id is its number, from 0, in the order of file names and of the records in them.

    A label that begins with f is fraud. Records without a vector, with one of
    another length (unless ``dims`` is None) or with nulls in it are left out,
    or with ``keep_bad`` marked by a false ``good``; they have numbers all the
    same. Files may be arrays or lines. Records are flat, so a closing brace
    ends one, and Spark splits a file at them: a large array is read by many
    tasks (a gzipped one by one).
    """
    texts = read_blocks(spark, path, "}").withColumn("t", F.regexp_replace("value", r"^[\s,\[\]]+", "")).filter("t <> ''")
    raw = numbered(texts.select("file", "block", F.from_json(F.concat("t", F.lit("}")), SCHEMA).alias("r")), "ref_id").select("ref_id", "r.*")
    good = F.col("vector").isNotNull() & F.col("label").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    if dims is not None:
        good = good & (F.size("vector") == dims)
    out = raw if keep_bad else raw.filter(good)
    return out.select("ref_id", F.col("vector").alias("v"), F.startswith("label", F.lit("f")).alias("is_fraud"), *([F.coalesce(good, F.lit(False)).alias("good")] if keep_bad else []))


def write_references(refs: DataFrame, path: str, compression: str | None = None) -> None:
    """Rows (v, is_fraud) as JSON lines of records, plain or compressed (``gzip``)."""
    label = F.when(F.col("is_fraud"), "fraud").otherwise("legit")
    refs.select(F.col("v").alias("vector"), label.alias("label")).write.mode("overwrite").json(path, compression=compression)


def count_records(texts: DataFrame, column: str = "value") -> DataFrame:
    """n: the records in texts of flat objects, by their closing braces; nothing is parsed."""
    return texts.agg(F.coalesce(F.sum(F.length(column) - F.length(F.replace(F.col(column), F.lit("}"), F.lit("")))), F.lit(0)).cast("bigint").alias("n"))
