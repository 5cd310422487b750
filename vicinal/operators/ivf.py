"""Nearest neighbours over the clustered index: seed, prune, refine.

Seed: each query's closest cluster is scanned for a first top-k, whose worst
distance bounds the answer. Prune: a cluster whose bounding box is farther
than that bound cannot hold a closer row. Refine: the clusters that are left
are scanned, and both sets meet in one top-k.

Mode ``exact`` refines with every cluster whose bound is at most the worst
distance, so the result, ties by ref_id included, is that of brute force. Mode
``capped`` refines with at most ``CAP`` clusters, those of the smallest bound,
whatever their number; it may miss neighbours.

Clusters' statistics go to all tasks (K is bounded). Queries meet the references
of their clusters by the k-NN join of ``knn``: a few queries go to all tasks,
more are dealt into cells with the references. Either way the references are
joined with the selected clusters on the column that their files lie by, so
Spark prunes the others' files when the query runs. In the refining step a
query brings its worst seed distance along, beyond which nothing is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions import vectors
from vicinal.operators.index import Index
from vicinal.operators.kmeans import MOST_CLUSTERS
from vicinal.operators.knn import FEW_QUERIES, K, _asked, _numbers, in_cells, matrix, nearest, partial_distances, top_k
from vicinal.session import written

CAP = 8
MODES = ("exact", "capped")


def box_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box, added up by dimensions."""
    out = np.zeros((len(q), len(lo)), np.int64)
    for dim in range(lo.shape[1]):
        x = q[:, dim, None]
        gap = np.maximum(0, np.maximum(lo[:, dim] - x, x - hi[:, dim]))
        out += gap * gap
    return out


class Clusters:
    """What a task needs of the clusters: ids of those with rows, centroids on the quantized scale, boxes."""

    def __init__(self, index: Index) -> None:
        if index.meta.count() > MOST_CLUSTERS:
            raise ValueError(f"an index has at most {MOST_CLUSTERS} clusters")
        rows = index.meta.filter("row_count > 0").select("cluster_id", "lo", "hi").orderBy("cluster_id").toArrow()
        self.ids = rows.column("cluster_id").to_numpy().astype(np.int32)
        self.lo, self.hi = (np.array(rows.column(c).to_pylist(), np.int64).reshape(len(self.ids), -1) for c in ("lo", "hi"))
        self.centroids = index.centroids[self.ids] * vectors.SCALE if len(self.ids) else np.zeros((0, index.dims))

    def nearest(self, q: np.ndarray) -> np.ndarray:
        d = np.zeros((len(q), len(self.ids)))
        for dim in range(self.centroids.shape[1]):
            d += (q[:, dim, None] - self.centroids[:, dim]) ** 2
        return self.ids[d.argmin(axis=1)]


def probes(queries: DataFrame, clusters: Clusters) -> DataFrame:
    """q_id, v, cluster_id: each query's closest cluster with rows."""
    shared = queries.sparkSession.sparkContext.broadcast(clusters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if len(shared.value.ids) else 0, 512):
                part = batch.slice(at, 512)
                found = shared.value.nearest(matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=["q_id", "v", "cluster_id"])

    return queries.select("q_id", "v").mapInArrow(run, "q_id bigint, v array<int>, cluster_id int")


def selections(seeded: DataFrame, clusters: Clusters, mode: str, cap: int = CAP) -> DataFrame:
    """q_id, v, worst, cluster_id: the clusters to refine with, from rows q_id, v, probed, worst (null: fewer than k rows seen)."""
    shared = seeded.sparkSession.sparkContext.broadcast(clusters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                bounds = box_bounds(matrix(part.column(1), np.int64), c.lo, c.hi)
                probed = part.column(2).to_numpy()
                worst = part.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                chosen = (c.ids != probed[:, None]) & ((bounds <= worst[:, None]) | np.isnan(worst)[:, None])
                if mode == "capped":
                    for i, row in enumerate(bounds):
                        others = np.flatnonzero(c.ids != probed[i])
                        chosen[i, others[np.lexsort((c.ids[others], row[others]))[cap:]]] = False
                rows, found = np.nonzero(chosen)
                if len(rows):
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), taken.column(3), pa.array(c.ids[found])], names=["q_id", "v", "worst", "cluster_id"])

    return seeded.select("q_id", "v", "probed", "worst").mapInArrow(run, "q_id bigint, v array<int>, worst bigint, cluster_id int")


def within(refs: DataFrame, selected: DataFrame) -> DataFrame:
    """The references of the clusters that ``selected`` (a written table) names; the others' files are pruned when the query runs.

    There are at most as many ids as clusters, which an index bounds.
    """
    return refs.join(F.broadcast(selected.filter("cluster_id >= 0").select("cluster_id").distinct()), "cluster_id", "left_semi")


def scan(selected: DataFrame, refs: DataFrame, k: int = K, few: int = FEW_QUERIES) -> DataFrame:
    """q_id, ref_id, d, is_fraud: lists with the k nearest of each query in its selected clusters, but for the query itself."""
    return nearest(selected, within(refs, selected).withColumnRenamed("q", "v"), k, few=few)


class Search:
    """The steps of a search; seed and selection are written tables, as each is used twice."""

    def __init__(self, queries: DataFrame, index: Index, mode: str = "exact", k: int = K, cap: int = CAP, few: int = FEW_QUERIES) -> None:
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        clusters = Clusters(index)
        self.probe = written(probes(queries, clusters), "probes")
        self.seed = written(top_k(scan(self.probe, index.refs, k, few), k).drop("rank"), "seeds")
        worst = self.seed.groupBy("q_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("worst"))
        seeded = self.probe.withColumnRenamed("cluster_id", "probed").join(worst, "q_id", "left")
        self.selected = written(selections(seeded, clusters, mode, cap), "selected")


def search(queries: DataFrame, index: Index, mode: str = "exact", k: int = K, cap: int = CAP, few: int = FEW_QUERIES) -> DataFrame:
    """q_id, ref_id, d, is_fraud, rank for each of ``queries`` (q_id, v integers)."""
    s = Search(queries, index, mode, k, cap, few)
    return top_k(s.seed.unionByName(scan(s.selected, index.refs, k, few)), k)


def search_cost(queries: DataFrame, index: Index, mode: str = "exact", k: int = K, cap: int = CAP) -> DataFrame:
    """q_id and the number of clusters refined with: how well the boxes prune."""
    s = Search(queries, index, mode, k, cap)
    chosen = s.selected.groupBy("q_id").agg(F.count(F.lit(1)).alias("refined"))
    return s.probe.select("q_id").join(chosen, "q_id", "left").select("q_id", F.coalesce("refined", F.lit(0)).alias("refined"))


def spread(refs: DataFrame, vector: str = "q") -> np.ndarray:
    """The dimensions of integer vectors, those of the largest variance first, of equals the first.

    Tasks add up their own rows; n * sum of squares - square of sum is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, 0, 0
        for batch in batches:
            x = matrix(batch.column(0), np.int64)
            if len(x):
                n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), pa.array(sums), pa.array(squares)], names=["dim", "n", "s", "ss"])

    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = refs.select(vector).mapInArrow(run, "dim int, n bigint, s bigint, ss bigint").groupBy("dim").agg(total("n"), total("s"), total("ss")).collect()
    return np.array([r["dim"] for r in sorted(rows, key=lambda r: (int(r["s"]) ** 2 - int(r["n"]) * int(r["ss"]), r["dim"]))], np.int64)


def elimination(queries: DataFrame, index: Index, k: int = K) -> DataFrame:
    """q_id, compared, dropped: the references of the refining clusters, and those whose partial distance, over the half of the dimensions that spread most, is beyond the worst seed."""
    s = Search(queries, index, "exact", k)
    half = spread(index.refs)[: index.dims // 2]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors, worst, _ = _asked(left)
        counts = np.zeros((2, len(ids)), np.int64)
        if len(ids) and right.num_rows:
            own, r = _numbers(right.column("ref_id")), matrix(pa.concat_arrays(right.column("v").chunks))
            for at in range(0, len(own), 2048):
                for first in range(0, len(ids), 512):
                    who = slice(first, first + 512)
                    other = ids[who, None] != own[None, at : at + 2048]
                    part = partial_distances(vectors[who][:, half], r[at : at + 2048][:, half])
                    counts[0, who] += other.sum(axis=1)
                    counts[1, who] += (other & (part > worst[who, None])).sum(axis=1)
        return pa.table({"q_id": ids, "compared": counts[0], "dropped": counts[1]})

    refs = within(index.refs, s.selected).select("ref_id", F.col("q").alias("v"), "is_fraud", "cluster_id")
    each = in_cells(s.selected, refs, run, "q_id bigint, compared bigint, dropped bigint")
    found = each.groupBy("q_id").agg(F.sum("compared").alias("compared"), F.sum("dropped").alias("dropped"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.probe.select("q_id").join(found, "q_id", "left").select("q_id", count("compared"), count("dropped"))
