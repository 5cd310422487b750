"""Evaluation: accuracy, recall, percentiles, histograms, summaries, deltas of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, expected: str = "expected_approved", actual: str = "approved") -> DataFrame:
    """One row: total, the four counts and accuracy; a null answer counts as an error."""
    e, a = F.col(expected), F.col(actual)
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(e & a).alias("approved_right"), F.count_if(~e & ~a).alias("denied_right"),
        F.count_if(~e & a).alias("approved_wrong"), F.count_if(e & ~a).alias("denied_wrong"), F.count_if(a.isNull()).alias("errors"),
    )
    return counts.withColumn("accuracy", F.when(F.col("total") > 0, (F.col("approved_right") + F.col("denied_right")) / F.greatest("total", F.lit(1))))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """hits, wanted and recall of (q_id, ref_id) pairs."""
    hits = truth.select("q_id", "ref_id").join(found.select("q_id", "ref_id").distinct(), ["q_id", "ref_id"], "left_semi")
    one = hits.agg(F.count(F.lit(1)).alias("hits")).join(truth.agg(F.count(F.lit(1)).alias("wanted")))
    return one.withColumn("recall", F.when(F.col("wanted") > 0, F.col("hits") / F.greatest("wanted", F.lit(1))))


def nearest_rank(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles sorted[round(p * (n - 1))] by group.

    Equal values are counted first, with map-side combining, so what is sorted
    is a row a distinct value; a running count then finds each rank.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*group).orderBy(value)
    upto = counts.withColumn("_upto", F.sum("_n").over(by)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    place = lambda p: F.round(F.lit(p) * (F.col("_all") - 1))
    return upto.groupBy(*group).agg(*(F.min(F.when(F.col("_upto") > place(p), F.col(value))).alias(name) for name, p in shares.items()))


#: Entries of a sketch, and how far a rank may be off, as a share of all rows: nearly four times what 99 of 100 sketches of
#: this size keep to (about 0.36 %; Karnin, Lang and Liberty 2016), as sketches draw at random.
SKETCH_SIZE, SKETCH_ERROR = 800, 0.0133


def sketches(rows: DataFrame, group: list[str], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """group, n, sketch: the integers of each group as a KLL sketch of bounded size, put together from those that tasks make."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(value), F.lit(size)).alias("sketch"))


def merged_sketches(found: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of smaller groups, merged: windows of snapshots, days of a month."""
    return found.groupBy(*group).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketch_quantiles(found: DataFrame, group: list[str], shares: dict[str, float]) -> DataFrame:
    """group, n and the value at each share, by the sketch: its rank is within ``SKETCH_ERROR`` of the share."""
    return found.select(*group, "n", *(F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(name) for name, p in shares.items()))


def log2_histogram(rows: DataFrame, group: list[str], bucket: Column) -> DataFrame:
    """group, bucket, n."""
    return rows.groupBy(*group, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(histogram: DataFrame, group: list[str], shares: dict[str, float]) -> DataFrame:
    """2 ** b (0 for bucket 0) of the first bucket b at which max(1, floor(p * n)) observations are reached, by group."""
    upto = histogram.withColumn("_upto", F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))).withColumn("_all", F.sum("n").over(Window.partitionBy(*group)))
    wanted = lambda p: F.greatest(F.lit(1), F.floor(F.lit(p) * F.col("_all")))
    first = upto.groupBy(*group).agg(*(F.min(F.when(F.col("_upto") >= wanted(p), F.col("bucket"))).alias(name) for name, p in shares.items()))
    return first.select(*group, *(F.when(F.col(name) == 0, 0).otherwise(F.pow(F.lit(2.0), F.col(name))).cast("bigint").alias(name) for name in shares))


def window_histogram(snapshots: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, order, bucket, n: what each snapshot's cumulative buckets (by, order, bucket, n) have more than those before."""
    before = F.lag("n", 1, 0).over(Window.partitionBy(*by, "bucket").orderBy(order))
    return snapshots.select(*by, order, "bucket", (F.col("n") - before).alias("n")).filter("n > 0")


def bucket_summary(rows: DataFrame, name: Column, value: Column, bucket: Column) -> DataFrame:
    """name, n, mean (integer), p50, p90, p99, p999 (from log2 buckets), max of each name."""
    each = rows.select(name.alias("name"), value.alias("v"), bucket.alias("bucket"))
    whole = each.groupBy("name").agg(F.count("v").alias("n"), F.floor(F.sum("v") / F.greatest(F.count("v"), F.lit(1))).cast("bigint").alias("mean"), F.max("v").alias("max"))
    shares = histogram_quantile(log2_histogram(each, ["name"], F.col("bucket")), ["name"], {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999})
    return whole.join(shares, "name")


def run_stats(runs: DataFrame, label: str, order: str) -> DataFrame:
    """label, runs, cold_ns, min_ns, median_ns, mib_per_s, records_per_s of timed runs (label, order, ns, bytes, records).

    The first run is the cold one and counts apart; the median is the sorted
    warm runs' entry n div 2; throughput is that of the fastest. Equal times
    are counted first, so what is sorted is a row a distinct time.
    """
    first = runs.groupBy(label).agg(F.min(F.struct(order, "ns")).alias("_f"))
    runs = runs.join(first, label).filter(F.col(order) > F.col(f"_f.{order}"))
    counts = runs.groupBy(label, "ns").agg(F.count(F.lit(1)).alias("_n"), F.max("bytes").alias("bytes"), F.max("records").alias("records"))
    upto, every = F.sum("_n").over(Window.partitionBy(label).orderBy("ns")), F.sum("_n").over(Window.partitionBy(label))
    placed = counts.withColumn("_upto", upto).withColumn("_all", every)
    best = F.min(F.struct("ns", "bytes", "records"))
    out = placed.groupBy(label).agg(F.max("_all").alias("runs"), best.alias("_b"), F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("ns"))).alias("median_ns"))
    seconds = F.col("_b.ns") / 1e9
    return out.join(first, label).select(
        label, "runs", F.col("_f.ns").alias("cold_ns"), F.col("_b.ns").alias("min_ns"), "median_ns",
        (F.col("_b.bytes") / (1024 * 1024) / seconds).alias("mib_per_s"), (F.col("_b.records") / seconds).alias("records_per_s"),
    )


def summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """count, min, max, mean, population standard deviation by group."""
    v = F.col(value)
    return rows.groupBy(*group).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"))


def deltas(snapshots: DataFrame, by: list[str], order: str, counters: list[str]) -> DataFrame:
    """Each counter minus its value in the snapshot before, of the same instance; null for the first."""
    before = Window.partitionBy(*by).orderBy(order)
    return snapshots.select(*by, order, *((F.col(c) - F.lag(c).over(before)).alias(f"{c}_delta") for c in counters))


def rates(snapshots: DataFrame, by: list[str], order: str, total: str, parts: list[str]) -> DataFrame:
    """by, order, the deltas of ``total`` and ``parts``, per_second of total, and each part's ratio to total.

    ``order`` is in seconds. An instance's first snapshot has no delta; a window
    without any of ``total`` has ratios of 0.
    """
    before = Window.partitionBy(*by).orderBy(order)
    delta = lambda c: F.col(c) - F.lag(c).over(before)
    rows = snapshots.select(*by, order, delta(order).alias("_dt"), *(delta(c).alias(f"{c}_delta") for c in (total, *parts)))
    each = F.col(f"{total}_delta")
    ratio = lambda c: F.when(each > 0, F.col(f"{c}_delta") / F.greatest(each, F.lit(1))).when(each.isNotNull(), 0.0)
    speed = F.when(F.col("_dt") > 0, each / F.greatest("_dt", F.lit(1))).when(each.isNotNull(), 0.0)
    return rows.select(*by, order, *(f"{c}_delta" for c in (total, *parts)), speed.alias("per_second"), *(ratio(c).alias(f"{c}_per_{total}") for c in parts))
