"""What the training-data operators share: the shared folder, written tables, small Python helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.session import written

__all__ = ["broadcast_if_small", "chunk_count", "hashed", "held_out", "partitions", "written"]

#: Rows with this remainder are held out from learning labels.
HELD_OUT_MOD = 5


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(df: DataFrame) -> int:
    """Chunks for a prefix sum in two levels: about as many as rows in a chunk, whatever the cluster's settings."""
    return max(1, math.isqrt(df.count()))


def hashed(df: DataFrame) -> Column:
    """A hash of all columns but those that hold maps, which have no order."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows from which no label is learnt (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_MOD == 0


#: Tables of up to so many narrow rows are broadcast where a side of a join may be small.
BROADCAST_ROWS = 500_000


def broadcast_if_small(written_table: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint behind a check of its size; beyond it, Spark joins by a shuffle.

    Only written tables are taken: their rows are counted from the files' footers, and nothing is worked out twice.
    """
    return F.broadcast(written_table) if written_table.count() <= most_rows else written_table
