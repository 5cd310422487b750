"""Vector kernels as column expressions: quantization, distances, bounds.

Values in [-1, 1] become integers in [-SCALE, SCALE], rounded half away from
zero. Sums of squares are 64-bit: a difference is at most 2 * SCALE, so its
square fits 32 bits and a sum of them does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000
SMALLEST, LARGEST = -32768, 32767


def quantize(vector: Column, scale: int = SCALE) -> Column:
    """Integers round(x * scale), in 32-bit float arithmetic, half away from zero."""
    return F.transform(vector, lambda x: F.round(x.cast("float") * F.lit(scale).cast("float")).cast("int"))


def quantize_row(vector: Column, scale: int = SCALE) -> Column:
    """As ``quantize``, held to the range of 16-bit integers."""
    return F.transform(quantize(vector, scale), lambda x: F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), x)).cast("smallint"))


def dequantize(vector: Column, scale: int = SCALE) -> Column:
    """32-bit floats x * (1 / scale)."""
    return F.transform(vector, lambda x: (x.cast("float") * F.lit(1.0 / scale).cast("float")).cast("float"))


def _total(terms: Column, kind: str) -> Column:
    return F.aggregate(terms, F.lit(0).cast(kind), lambda s, x: s + x)


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of integer vectors, exact."""
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("bigint") - y) * (x.cast("bigint") - y)), "bigint")


def l2_sq_float(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), "double")


def dot(a: Column, b: Column) -> Column:
    """Inner product of integer vectors, exact."""
    return _total(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y), "bigint")


def norm_sq(a: Column) -> Column:
    return _total(F.transform(a, lambda x: x.cast("bigint") * x), "bigint")


def score(row: Column, centroid: Column) -> Column:
    """2 * row . centroid - |centroid|^2: largest where the distance is smallest."""
    return dot(row, centroid) * 2 - norm_sq(centroid)


def bbox_lower_bound_sq(query: Column, lo: Column, hi: Column) -> Column:
    """The least squared distance from a query to any point of a box; 0 inside."""
    gaps = F.zip_with(query, F.arrays_zip(lo.alias("lo"), hi.alias("hi")), lambda q, b: F.greatest(F.lit(0).cast("bigint"), b["lo"].cast("bigint") - q, q.cast("bigint") - b["hi"]))
    return _total(F.transform(gaps, lambda g: g * g), "bigint")


def pack_bits(flag: Column, position: Column) -> Column:
    """Aggregate: a 64-bit word with the bit ``position % 64`` set where ``flag`` holds (group by position div 64)."""
    return F.bit_or(F.when(flag, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("bigint")))


def bit_at(word: Column, position: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, F.pmod(position, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
