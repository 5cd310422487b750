"""K-means over vectors in tables: deterministic Lloyd iterations, k-means++ and assignment.

Centroids are few (K rows, at most ``MOST_CLUSTERS``), so each iteration sends
them to all tasks and brings K partial sums back. Rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.functions import vectors
from vicinal.operators.knn import matrix
from vicinal.operators.sampling import stride_sample
from vicinal.session import written

MOST_CLUSTERS = 65_536
ITERATIONS = 40
#: So many numbers of all tasks' sums may come to the driver as they are.
FEW_SUMS = 2**21
#: Rounds in which the candidates of k-means++ are drawn.
ROUNDS = 5


def _closest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the closest centroid (the first of equals) and its squared distance."""
    d = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centroids.T + (centroids * centroids).sum(axis=1)[None, :]
    best = d.argmin(axis=1)
    return best, np.maximum(d[np.arange(len(rows)), best], 0)


def assign(rows: DataFrame, centroids: np.ndarray, vector: str = "v") -> DataFrame:
    """``rows`` with cluster_id and dist_sq of the closest centroid; ties go to the lowest cluster."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(np.asarray(centroids, np.float64))
    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, d = [], []
            for start in range(0, batch.num_rows, 4096):
                b, x = _closest(matrix(batch.column(at).slice(start, 4096)), shared.value)
                best.append(b), d.append(x)
            if best:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(best).astype(np.int32)), pa.array(np.concatenate(d))], names=[*batch.schema.names, "cluster_id", "dist_sq"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{columns}, cluster_id int, dist_sq double")


def assign_sql(rows: DataFrame, centroids: DataFrame, vector: str = "v") -> DataFrame:
    """As ``assign`` with integer vectors and a table of centroids (cluster_id, centroid), in expressions only, exact."""
    all_ = F.array_sort(F.collect_list(F.struct("cluster_id", "centroid")))
    few = F.when(F.size(all_) <= MOST_CLUSTERS, all_).otherwise(F.raise_error(F.lit(f"more than {MOST_CLUSTERS} centroids")))
    table = F.broadcast(centroids.agg(few.alias("_c")))
    distances = F.transform("_c", lambda c: F.struct(vectors.l2_sq(F.col(vector), c["centroid"]).alias("d"), c["cluster_id"].alias("cluster_id")))
    best = F.array_min(distances)
    return rows.join(table).withColumn("_best", best).withColumn("cluster_id", F.col("_best.cluster_id")).withColumn("dist_sq", F.col("_best.d")).drop("_c", "_best")


def lloyd_sums(assigned: DataFrame, vector: str = "v") -> DataFrame:
    """cluster_id, dim, total, n: the sums behind the next centroids."""
    each = assigned.select("cluster_id", F.posexplode(vector).alias("dim", "x"))
    return each.groupBy("cluster_id", "dim").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))


def step(rows: DataFrame, centroids: np.ndarray, vector: str = "v", tasks: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The means of the rows closest to each centroid, and their numbers; an empty cluster keeps its centroid.

    The tasks' sums are added up by Spark, or where ``tasks`` of them are few
    numbers, where they arrive.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums, counts = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                x = matrix(batch.column(0).slice(start, 4096))
                best, _ = _closest(x, c)
                order = np.argsort(best, kind="stable")
                found, first = np.unique(best[order], return_index=True)
                sums[found] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(best, minlength=len(c))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at]), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["c", "n", "s"])

    parts = rows.select(vector).mapInArrow(run, "c int, n bigint, s array<double>")
    dims = centroids.shape[1]
    few = tasks is not None and tasks * centroids.size <= FEW_SUMS
    total = (parts if few else parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s"))).toArrow()
    shared.unpersist()
    sums, counts = np.zeros(centroids.shape), np.zeros(len(centroids), np.int64)
    # In an order of their own, so that reruns add up the same way.
    for c, n, s in sorted(zip(*[x.to_pylist() for x in total.columns], strict=True)):
        sums[c] += s
        counts[c] += n
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids), counts


def _vectors(picked: DataFrame, order: str, vector: str) -> np.ndarray:
    found = picked.orderBy(order).select(vector).toArrow().column(vector).combine_chunks()
    return matrix(found)


def kmeans_fast(rows: DataFrame, k: int, key: str = "ref_id", vector: str = "v", sample: int = 0, iterations: int = ITERATIONS) -> np.ndarray:
    """Centroids without any random draw: stride sample, stride start, Lloyd steps until nothing moves.

    ``sample`` rows are learnt from (0: all). Starts are every (n / k)-th row.
    """
    if not 0 < k <= MOST_CLUSTERS:
        raise ValueError(f"k must be 1 to {MOST_CLUSTERS}")
    data = stride_sample(rows, key, sample).drop("position", "sample") if sample else rows
    centroids = _vectors(stride_sample(data, key, k), "sample", vector)
    tasks = data.rdd.getNumPartitions()
    for _ in range(iterations):
        after, _n = step(data, centroids, vector, tasks)
        if np.array_equal(after, centroids):
            break
        centroids = after
    return centroids


def _u(key: str, *salt: int):
    """A number in (0, 1) from a hash of the row's key."""
    return (F.shiftrightunsigned(F.xxhash64(F.col(key), *map(F.lit, salt)), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _drawn(rows: DataFrame, key: str, vector: str, *salt: int) -> np.ndarray | None:
    """The vector of the row with the smallest hash."""
    row = rows.agg(F.min_by(vector, F.struct(_u(key, *salt), F.col(key))).alias("v")).first()["v"]
    return None if row is None else np.array(row, np.float64)


def _weighted_starts(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ among a few weighted candidates."""
    rng, left = np.random.default_rng(seed), np.full(len(candidates), np.inf)
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    while len(chosen) < k:
        left = np.minimum(left, ((candidates - candidates[chosen[-1]]) ** 2).sum(axis=1))
        mass = left * weights
        if not mass.sum():
            break  # all candidates are chosen
        chosen.append(int(rng.choice(len(candidates), p=mass / mass.sum())))
    return candidates[chosen]


def kmeans_plus_plus(rows: DataFrame, k: int, key: str = "ref_id", vector: str = "v", seed: int = 42, iterations: int = ITERATIONS) -> np.ndarray:
    """Centroids from k-means++ starts, drawn in rounds (k-means||, Bahmani et al. 2012).

    Each of ``ROUNDS`` rounds takes every row by itself with a probability in
    proportion to its squared distance to the candidates so far, about 2k rows
    a round; the candidates, weighted by the rows that are closest to them, are
    then few enough for k-means++ on the driver. So starts take ROUNDS passes
    over the rows, not k. Draws use a seeded hash of the row's key, so reruns
    agree. An empty cluster starts again at a row drawn in the same way.
    """
    first = _drawn(rows, key, vector, seed, 0)
    if first is None:
        return np.zeros((0, 0))
    candidates = first[None, :]
    for turn in range(1, ROUNDS + 1):
        weighed = assign(rows.select(key, vector), candidates, vector)
        total = weighed.agg(F.sum("dist_sq")).first()[0]
        if not total:
            break  # every row is a candidate
        picked = weighed.filter(_u(key, seed, turn) * F.lit(total) < F.lit(2.0 * k) * F.col("dist_sq"))
        more = _vectors(picked, key, vector)
        if len(more):
            candidates = np.unique(np.vstack([candidates, more]), axis=0)
    _, weights = step(rows, candidates, vector)
    centroids = _weighted_starts(candidates, weights.astype(float), k, seed)
    tasks = rows.rdd.getNumPartitions()
    for turn in range(iterations):
        after, counts = step(rows, centroids, vector, tasks)
        for empty in np.flatnonzero(counts == 0):
            after[empty] = _drawn(rows, key, vector, seed, turn + 1, int(empty) + 1)
        if np.array_equal(after, centroids):
            break
        centroids = after
    return centroids


def min_distances(rows: DataFrame, chosen: DataFrame, vector: str = "v") -> DataFrame:
    """ref_id and min_d2, the squared distance to the closest of the chosen rows (integers, exact)."""
    found = assign_sql(rows, chosen, vector)
    return found.select("ref_id", F.col("dist_sq").alias("min_d2"))


def inverse_cdf_pick(weighted: DataFrame, share: float, ranges: int = 256, few: int = 100_000) -> DataFrame:
    """The first row by ref_id at which the running sum of min_d2 reaches ``share`` of the total, with that sum.

    Sums over ranges of ids tell in which range the mark is crossed; that range
    is cut again until it has few ids, and only then its rows are sorted. The
    distances are written first, as each cut reads them.
    """
    weighted = written(weighted, "weighted")
    seen = weighted.agg(F.sum("min_d2").alias("t"), F.min("ref_id").alias("lo"), F.max("ref_id").alias("hi")).first()
    if seen["t"] is None:
        return weighted.withColumn("running", F.lit(0).cast("bigint")).limit(0)
    mark, lo, hi, before = share * seen["t"], seen["lo"], seen["hi"], 0
    while hi - lo >= few:
        width = (hi - lo) // ranges + 1
        at = F.floor((F.col("ref_id") - lo) / width)
        sums = weighted.filter(F.col("ref_id").between(lo, hi)).groupBy(at.alias("r")).agg(F.sum("min_d2").alias("s")).orderBy("r").collect()
        for row in sums:
            if before + row["s"] >= mark or row is sums[-1]:
                break
            before += row["s"]
        lo, hi = lo + row["r"] * width, min(hi, lo + (row["r"] + 1) * width - 1)
    own = weighted.filter(F.col("ref_id").between(lo, hi)).withColumn("running", F.sum("min_d2").over(Window.orderBy("ref_id").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before))
    return own.filter(F.col("running") >= F.lit(mark)).orderBy("ref_id").limit(1)
