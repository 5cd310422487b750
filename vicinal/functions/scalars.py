"""Scalar expressions of the feature rules and of the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """min(1, max(0, x)) as a 32-bit float."""
    return F.least(F.lit(1.0).cast("float"), F.greatest(F.lit(0.0).cast("float"), x.cast("float")))


def scaled(x: Column, by: float) -> Column:
    """x / by in 32-bit floats, held to [0, 1]."""
    return clamp01((x.cast("float") / F.lit(by)).cast("float"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b in double precision, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def day_of(year: Column, month: Column, day: Column) -> Column:
    """A date from parts whose day may lie beyond the month's end: it runs on into the next month."""
    return F.date_add(F.make_date(year, month, F.lit(1)), day - 1)


def log2_bucket(v: Column) -> Column:
    """0 for 0, else the number of bits of v."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v)))


def blocks(rows: Column, per_block: int = 8) -> Column:
    """Blocks needed for so many rows."""
    return F.floor((rows + (per_block - 1)) / per_block).cast("bigint")
