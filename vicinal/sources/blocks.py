"""Places in the order of files: text that Spark splits into blocks, numbered as if it were read from end to end.

Spark packs blocks of many files into tasks by size, so neither tasks nor
``monotonically_increasing_id`` follow the files. A row's place has two levels:
the rows of all files and blocks before its own, from a table of a row a block,
and its place inside its block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.session import written

#: Tables of blocks with at most so many rows are sent to all tasks.
FEW_BLOCKS = 200_000


def read_blocks(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """file, block (where it begins), value: the lines of text files, or what a separator of one character ends; a block's rows come in order."""
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("lineSep", separator) if separator else reader
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def few(blocks: DataFrame) -> DataFrame:
    """A written table of blocks, sent to all tasks if it is small."""
    return F.broadcast(blocks) if blocks.count() <= FEW_BLOCKS else blocks


def starts(blocks: DataFrame, count: str = "n") -> DataFrame:
    """``blocks`` (file, block, count) with ``before``: what all blocks before have, in the order of file names and places.

    Blocks are summed within their file and files after one another, so the one
    sort of all rows has a row a file.
    """
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum(count).alias("_all"))
    files = files.select("file", F.coalesce(F.sum("_all").over(upto(Window.orderBy("file"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(count).over(upto(Window.partitionBy("file").orderBy("block"))), F.lit(0))
    return blocks.withColumn("_inside", inside).join(files, "file").withColumn("before", (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_before", "_inside")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (file, block, ...), which come as ``read_blocks`` reads them, with their place from 0 over all files.

    They are written once with a number that rises within a task, so that the
    first number of each block and the rows agree whatever is run again.
    """
    held = written(rows.withColumn("_n", F.monotonically_increasing_id()), "blocks")
    blocks = held.groupBy("file", "block").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("n"))
    place = few(written(starts(blocks).select("file", "block", "_first", "before"), "starts"))
    return held.join(place, ["file", "block"]).withColumn(name, F.col("before") + F.col("_n") - F.col("_first")).drop("_n", "_first", "before")
