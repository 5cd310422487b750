import numpy as np
from pyspark.sql import functions as F

from vicinal.functions import scalars, vectors


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def array(values, kind="float"):
    return F.array(*[F.lit(v).cast(kind) for v in values])


def test_quantize_rounds_half_away_from_zero(spark):
    values = [0.00005, -0.00005, 0.00025, -0.00025, 1.0, -1.0, 0.0]
    got = one(spark, vectors.quantize(array(values)))[0]
    want = [int(np.sign(v) * np.floor(abs(np.float32(v) * np.float32(10000)) + np.float32(0.5))) for v in values]
    assert got == want


def test_rows_are_held_to_16_bits(spark):
    assert one(spark, vectors.quantize_row(array([5.0, -5.0])))[0] == [32767, -32768]


def test_quantization_error_is_at_most_half_a_step(spark):
    values = np.random.default_rng(1).uniform(-1, 1, 50).astype(np.float32)
    back = one(spark, vectors.dequantize(vectors.quantize(array(values.tolist()))))[0]
    assert np.abs(np.array(back) - values).max() <= 0.5001 / 10000


def test_distances_need_64_bits(spark):
    a, b = [10000] * 14, [-10000] * 14
    assert one(spark, vectors.l2_sq(array(a, "int"), array(b, "int")))[0] == 14 * 20000**2


def test_score_orders_as_distance(spark):
    rng = np.random.default_rng(2)
    row, cs = rng.integers(-100, 100, 8), rng.integers(-100, 100, (5, 8))
    scores = one(spark, *[vectors.score(array(row.tolist(), "int"), array(c.tolist(), "int")) for c in cs])
    assert int(np.argmax(list(scores))) == int(((cs - row) ** 2).sum(axis=1).argmin())


def test_box_bound(spark):
    q, lo, hi = array([0, 5, 10], "int"), array([1, 4, 2], "smallint"), array([3, 6, 7], "smallint")
    assert one(spark, vectors.bbox_lower_bound_sq(q, lo, hi))[0] == 1 + 0 + 9


def test_bits_round_trip(spark):
    flags = [i % 3 == 0 for i in range(130)]
    rows = spark.createDataFrame(list(enumerate(flags)), "i bigint, f boolean")
    words = rows.groupBy(F.floor(F.col("i") / 64).alias("w")).agg(vectors.pack_bits(F.col("f"), F.col("i")).alias("word"))
    back = rows.withColumn("w", F.floor(F.col("i") / 64)).join(words, "w").select("i", vectors.bit_at(F.col("word"), F.col("i")).alias("f"))
    assert [r["f"] for r in back.orderBy("i").collect()] == flags


def test_scalars(spark):
    row = one(
        spark, scalars.clamp01(F.lit(-3.0)), scalars.clamp01(F.lit(7.0)), scalars.ratio_or_zero(F.lit(3.0), F.lit(0.0)), scalars.log2_bucket(F.lit(0)),
        scalars.log2_bucket(F.lit(1)), scalars.log2_bucket(F.lit(1024)), F.weekday(scalars.day_of(F.lit(2026), F.lit(2), F.lit(31))), scalars.blocks(F.lit(9)),
    )
    assert list(row) == [0.0, 1.0, 0.0, 0, 1, 11, 1, 2]
