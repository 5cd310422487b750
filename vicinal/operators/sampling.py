"""Positions and samples of keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.session import written


def positions(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """The keys of ``df`` with each one's place (from 0) in their order.

    Spark cuts the keys into ranges, as many as there are partitions; the keys
    of a range are numbered after those of all ranges before. Only keys move.
    The table of ranges has a row a partition.
    """
    ranged = written(df.select(key).repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.withColumn("_inside", inside).join(F.broadcast(counts), "_range").select(key, (F.col("_before") + F.col("_inside") - 1).cast("bigint").alias(name))


def with_position(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """``df``, whose keys are distinct, with each row's place (from 0) in the order of the key, without a global sort."""
    return df.join(positions(df, key, name), key)


def stride_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """The rows at the places (i * n) div size for i = 0 .. size - 1, numbered by ``sample``; keys are distinct.

    Place p is picked as number i if i is the least with i * n >= p * size and
    (i * n) div size = p, so each key decides by itself; no list of places is made.
    """
    n = df.count()
    size = min(size, n)
    if not size:
        return df.withColumn("position", F.lit(0).cast("bigint")).withColumn("sample", F.lit(0).cast("bigint")).limit(0)
    number = F.floor((F.col("position") * size + (n - 1)) / F.lit(n)).cast("bigint")
    picked = (number < size) & (F.floor(number * n / F.lit(size)).cast("bigint") == F.col("position"))
    return df.join(written(positions(df, key).filter(picked).withColumn("sample", number), "places"), key)


def hash_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """A sample of exactly ``size`` rows (all, if there are fewer), the first by a seeded hash of the key."""
    return df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed))).orderBy("_hash", key).limit(size).drop("_hash")
