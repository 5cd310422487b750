"""Windows over time that one busy key does not bind to one task.

A key's rows are cut into buckets of time. What a window needs from other
buckets comes along: copies of rows for windows of bounded length, one row a
bucket for the row before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a bucket, where a window does not set them.
BUCKET = 86_400


def count_within(rows: DataFrame, by: list[str], seconds: str, length: int, name: str) -> DataFrame:
    """``rows`` with the number of rows of the same key in the ``length`` seconds before each, both ends and itself included.

    Buckets are as long as the window, so a row counts in its own bucket and in
    the next; it is copied there, and the copies are left out in the end.
    """
    bucket = F.floor(F.col(seconds) / length)
    copies = rows.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_bucket", bucket + F.col("_copy"))
    window = Window.partitionBy(*by, "_bucket").orderBy(seconds).rangeBetween(-length, 0)
    return copies.withColumn(name, F.count(F.lit(1)).over(window)).filter("_copy = 0").drop("_copy", "_bucket")


def since_last(rows: DataFrame, by: list[str], seconds: str, tie: str, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with ``last_sec``: the seconds of the row before, of the same key in the order of (seconds, tie); null for the first.

    In a bucket that is the row before; for a bucket's first row it is the last
    of the bucket before, from a table of a row a key and bucket.
    """
    cut = rows.withColumn("_bucket", F.floor(F.col(seconds) / bucket))
    order = Window.partitionBy(*by).orderBy("_bucket")
    ends = cut.groupBy(*by, "_bucket").agg(F.max(seconds).alias("_end"))
    ends = ends.select(*by, "_bucket", F.lag("_end").over(order).alias("_end"))
    inside = F.lag(seconds).over(Window.partitionBy(*by, "_bucket").orderBy(seconds, tie))
    found = cut.withColumn("_inside", inside)
    joined = found.join(ends, [*(found[c].eqNullSafe(ends[c]) for c in by), found["_bucket"].eqNullSafe(ends["_bucket"])], "left")
    return joined.select(*(found[c] for c in rows.columns), F.coalesce("_inside", "_end").alias("last_sec"))
