"""The clustered, quantized reference index: statistics, writing, checking, loading.

Rows are Parquet partitioned by cluster, so a join on selected clusters prunes
partitions at run time. Centroids, cluster statistics and a manifest of one
row lie beside them.

Clusters come from k-means, or from splits (``save_split``): a tree of cuts
through single dimensions, grown on a bounded sample, deals every row to a
leaf. Its boxes hardly overlap, a row is placed in a dozen comparisons whatever
the number of clusters, and that number follows the rows, so searches of a
share of the rows do not grow with their square.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.functions import scalars, vectors
from vicinal.operators import kmeans
from vicinal.operators.knn import matrix
from vicinal.session import written

MAGIC, VERSION = "VICINAL", 1
ROWS_PER_BLOCK = 8
#: A cluster's files: one for about so many of its rows, and at most so many.
FILE_ROWS, MOST_FILES = 125_000, 256
#: Rows that splits are grown on, about, and the least and most clusters that they make.
SPLIT_SAMPLE, LEAST_SPLIT, MOST_SPLIT = 200_000, 16, 4096
EMPTY_LO, EMPTY_HI = vectors.LARGEST, vectors.SMALLEST


class IndexError_(ValueError):
    """An index that cannot be used."""


class BadMagic(IndexError_):
    """The manifest is not one of this library."""


class UnsupportedVersion(IndexError_):
    """The index has another layout."""


class UnsupportedKClusters(IndexError_):
    """The index has another number of clusters than asked for."""


class UnsupportedFixScale(IndexError_):
    """The index was quantized on another scale."""


class Truncated(IndexError_):
    """The index has fewer or other rows than its manifest says."""


def cluster_counts(assigned: DataFrame, k: int) -> DataFrame:
    """cluster_id, row_count, row_start, n_blocks, block_start for all k clusters, empty ones included."""
    counts = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("row_count"))
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    full = every.join(counts, "cluster_id", "left").select("cluster_id", F.coalesce("row_count", F.lit(0)).alias("row_count"))
    full = full.withColumn("n_blocks", scalars.blocks(F.col("row_count"), ROWS_PER_BLOCK))
    before = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    return full.select("cluster_id", "row_count", start("row_count").alias("row_start"), "n_blocks", start("n_blocks").alias("block_start"))


def cluster_boxes(assigned: DataFrame, dims: int, vector: str = "q") -> DataFrame:
    """cluster_id, lo, hi: the bounding box of each cluster that has rows.

    Each task has the boxes of its own rows first, so what is shuffled is a few
    numbers a task and cluster.
    """
    kind = dict(assigned.dtypes)[vector]

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            x, cluster = matrix(batch.column(1), None), batch.column(0).to_numpy()
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            ends = (f.reduceat(x[order], first, axis=0) for f in (np.minimum, np.maximum)) if len(found) else ((), ())
            for c, lo, hi in zip(found, *ends, strict=True):
                own[c] = (np.minimum(lo, own[c][0]), np.maximum(hi, own[c][1])) if c in own else (lo, hi)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), *(pa.array([list(v[i]) for v in own.values()], batch.schema.field(1).type) for i in (0, 1))], names=["cluster_id", "lo", "hi"])

    parts = assigned.select(F.col("cluster_id").cast("int"), vector).mapInArrow(boxes, f"cluster_id int, lo {kind}, hi {kind}")
    ends = parts.select("cluster_id", F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "b")).groupBy("cluster_id", "dim").agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi"))
    whole = ends.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("b"))
    return whole.select("cluster_id", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))


def cluster_meta(assigned: DataFrame, k: int, dims: int, vector: str = "q") -> DataFrame:
    """Counts, starts and boxes of all clusters; the box of an empty one holds nothing."""
    fill = lambda c, v: F.coalesce(c, F.array_repeat(F.lit(v).cast("smallint"), dims))
    out = cluster_counts(assigned, k).join(cluster_boxes(assigned, dims, vector), "cluster_id", "left")
    return out.withColumn("lo", fill("lo", EMPTY_LO)).withColumn("hi", fill("hi", EMPTY_HI))


def build(refs: DataFrame, k: int, vector: str = "v", sample: int = 0, iterations: int = kmeans.ITERATIONS, centroids: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """``refs`` (ref_id, v floats, is_fraud) with q and cluster_id, and the centroids, on the scale of v."""
    if centroids is None:
        centroids = kmeans.kmeans_fast(refs, k, vector=vector, sample=sample, iterations=iterations)
    rows = kmeans.assign(refs, centroids, vector).withColumn("q", vectors.quantize_row(F.col(vector)))
    return rows.select("ref_id", "q", "is_fraud", "cluster_id"), centroids


def write(refs: DataFrame, path: str, k: int, **settings) -> None:
    """Cluster, quantize and write the index, replacing what is there."""
    save(*build(refs, k, **settings), path, k)


def save(rows: DataFrame, centroids: np.ndarray, path: str, k: int) -> None:
    """Write the index of rows (ref_id, q, is_fraud, cluster_id), replacing what is there."""
    spark, dims = rows.sparkSession, centroids.shape[1]
    rows = written(rows, "assigned")
    # Large clusters are written by several tasks, each sorted by id inside.
    parts = rows.groupBy("cluster_id").agg(F.least(F.lit(MOST_FILES), F.ceil(F.count(F.lit(1)) / FILE_ROWS)).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "cluster_id").withColumn("part", F.pmod(F.xxhash64("ref_id"), F.col("parts")))
    dealt.repartition("cluster_id", "part").select("ref_id", "q", "is_fraud", "cluster_id").sortWithinPartitions("cluster_id", "ref_id").write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/refs")
    cluster_meta(rows, k, dims).coalesce(1).write.mode("overwrite").parquet(f"{path}/cluster_meta")
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cluster_id int, centroid array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    manifest = spark.createDataFrame([(MAGIC, VERSION, rows.count(), k, vectors.SCALE, dims)], "magic string, format_version int, n bigint, k_clusters int, fix_scale int, dims int")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


class Splits:
    """A tree of cuts: a row goes left of a node where its value in the node's dimension is below the cut."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        """Grown on ``sample``: the leaf of the most rows is cut next, near the median of the dimension that spreads most, while its rows differ."""
        nodes, leaf_rows, heap = [(-1, 0, -1, -1)], {}, [(-len(sample), 0, np.arange(len(sample)))]
        while heap:
            _, node, rows = heapq.heappop(heap)
            x = sample[rows]
            spread = x.var(axis=0)
            dim = int(spread.argmax())
            if len(heap) + len(leaf_rows) + 1 >= leaves or not spread[dim]:
                leaf_rows[node] = rows
                continue
            values = np.sort(x[:, dim])
            cut = values[len(values) // 2]
            if cut == values[0]:
                cut = values[np.searchsorted(values, cut, "right")]
            below = x[:, dim] < cut
            nodes[node] = (dim, cut, len(nodes), len(nodes) + 1)
            for part in (rows[below], rows[~below]):
                heapq.heappush(heap, (-len(part), len(nodes), part))
                nodes.append((-1, 0, -1, -1))
        self.dim, self.cut, self.left, self.right = (np.array(c) for c in zip(*nodes, strict=True))
        self.leaf = np.full(len(nodes), -1, np.int32)
        self.leaf[list(leaf_rows)] = np.arange(len(leaf_rows))
        self.centroids = np.array([sample[rows].mean(axis=0) for rows in leaf_rows.values()])

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node, open_ = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_ := open_[self.dim[node[open_]] >= 0]):
            at = node[open_]
            node[open_] = np.where(rows[open_, self.dim[at]] < self.cut[at], self.left[at], self.right[at])
        return self.leaf[node]


def split_clusters(rows: int) -> int:
    """Clusters for so many rows, as their root: where a share of the rows is searched for, bounds of all clusters and distances within a few grow alike."""
    return int(min(MOST_SPLIT, max(LEAST_SPLIT, rows**0.5 / 2)))


def save_split(refs: DataFrame, path: str, k: int | None = None) -> int:
    """Write the index of ``refs`` (ref_id, v integers, is_fraud; a written table) by splits; the number of its clusters."""
    n = refs.count()
    sample = refs.filter(F.pmod(F.xxhash64("ref_id"), F.lit(n // SPLIT_SAMPLE + 1)) == 0).select("v").toArrow()
    splits = Splits(matrix(pa.concat_arrays(sample.column(0).chunks), np.int64), k or split_clusters(n))
    shared = refs.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.place(matrix(batch.column(1), np.int64)))], names=["ref_id", "q", "is_fraud", "cluster_id"])

    placed = refs.select("ref_id", F.col("v").cast("array<smallint>"), "is_fraud").mapInArrow(run, "ref_id bigint, q array<smallint>, is_fraud boolean, cluster_id int")
    save(placed, splits.centroids / vectors.SCALE, path, len(splits.centroids))
    return len(splits.centroids)


class Index:
    """A loaded index: tables refs (ref_id, q, is_fraud, cluster_id), meta, and centroids."""

    def __init__(self, refs: DataFrame, meta: DataFrame, centroids: np.ndarray, dims: int) -> None:
        self.refs, self.meta, self.centroids, self.dims = refs, meta, centroids, dims


def load(spark: SparkSession, path: str, k: int | None = None, scale: int = vectors.SCALE) -> Index:
    """The index below ``path``, after its manifest was checked; k=None takes any number of clusters."""
    manifest = spark.read.parquet(f"{path}/manifest").first()
    if manifest is None or "magic" not in manifest or manifest["magic"] != MAGIC:
        raise BadMagic(f"{path} has no manifest of this library")
    if manifest["format_version"] != VERSION:
        raise UnsupportedVersion(f"version {manifest['format_version']}; this library reads {VERSION}")
    if k is not None and manifest["k_clusters"] != k:
        raise UnsupportedKClusters(f"{manifest['k_clusters']} clusters; {k} were asked for")
    if manifest["fix_scale"] != scale:
        raise UnsupportedFixScale(f"scale {manifest['fix_scale']}; {scale} was asked for")
    refs, meta = spark.read.parquet(f"{path}/refs"), spark.read.parquet(f"{path}/cluster_meta")
    rows = meta.agg(F.sum("row_count"), F.count(F.lit(1))).first()
    if (rows[0] or 0, rows[1]) != (manifest["n"], manifest["k_clusters"]) or refs.count() != manifest["n"]:
        raise Truncated(f"the tables have {rows[0]} rows in {rows[1]} clusters; the manifest says {manifest['n']} in {manifest['k_clusters']}")
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cluster_id").toArrow().column("centroid").to_pylist()
    return Index(refs, meta, np.array(centroids), manifest["dims"])


def dequantized(index: Index) -> DataFrame:
    """ref_id, v, is_fraud with the vectors as floats again."""
    return index.refs.select("ref_id", vectors.dequantize(F.col("q")).alias("v"), "is_fraud")


def label_words(refs: DataFrame, position: str = "ref_id") -> DataFrame:
    """word_id, word: the labels packed 64 to a word."""
    return refs.groupBy(F.floor(F.col(position) / 64).cast("bigint").alias("word_id")).agg(vectors.pack_bits(F.col("is_fraud"), F.col(position)).alias("word"))
