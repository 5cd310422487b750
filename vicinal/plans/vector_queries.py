"""Queries over the embeddings: quantization, neighbours, clusters, index, evaluation.

Labels of 5 and more stand for fraud. Searches take every row whose id is
divisible by 100 as a query, against all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions import vectors
from vicinal.operators import evaluate, index, ivf, kmeans, knn, sampling
from vicinal.session import new_path, table, written
from vicinal.sources import references
from vicinal.streaming import score

CLUSTERS = 16
#: Lloyd steps of the query that shows centroids.
STEPS = 3
#: Clusters that the capped searches refine with. These vectors have no clusters to speak of, so a recall of 0.9 takes most of them.
CAPPED = 13


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, v (quantized), is_fraud."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ref_id"), vectors.quantize(F.col("embedding")).alias("v"), (F.col("label") >= 5).alias("is_fraud"))


def queries_of(rows: DataFrame) -> DataFrame:
    return rows.filter("ref_id % 100 = 0").select(F.col("ref_id").alias("q_id"), "v")


def starts(rows: DataFrame, k: int = CLUSTERS) -> DataFrame:
    """cluster_id, centroid: every (n / k)-th row."""
    return sampling.stride_sample(rows, "ref_id", k).select(F.col("sample").cast("int").alias("cluster_id"), F.col("v").alias("centroid"))


def assigned(rows: DataFrame) -> DataFrame:
    return kmeans.assign_sql(rows, starts(rows))


def empty_index(rows: DataFrame) -> index.Index:
    """The index of no rows."""
    meta = rows.sparkSession.createDataFrame([], "cluster_id int, row_count bigint, lo array<int>, hi array<int>")
    return index.Index(rows.select("ref_id", F.col("v").alias("q"), "is_fraud", F.lit(0).alias("cluster_id")), meta, np.zeros((0, 1)), 1)


def start_index(rows: DataFrame) -> index.Index:
    """An index over the stride clusters, written and loaded."""
    centroids = np.array([r["centroid"] for r in starts(rows).orderBy("cluster_id").collect()], float)
    if not len(centroids):
        return empty_index(rows)
    path = new_path(rows.sparkSession, "index")
    q = kmeans.assign(rows, centroids).select("ref_id", F.col("v").cast("array<smallint>").alias("q"), "is_fraud", "cluster_id")
    index.save(q, centroids / vectors.SCALE, path, len(centroids))
    return index.load(rows.sparkSession, path)


def quantize_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.quantize_row(F.col("embedding"))).alias("dim", "q")).withColumn("q", F.col("q").cast("int"))


def dequantize_vectors(spark, sf_dir):
    back = vectors.dequantize(vectors.quantize(F.col("embedding")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(back).alias("dim", "x")).select("vec_id", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


def knn_brute_i16(spark, sf_dir):
    rows = refs(spark, sf_dir)
    return knn.brute_force(queries_of(rows), rows).select("q_id", "rank", "ref_id", "d")


def knn_join_cells(spark, sf_dir):
    """As ``knn_brute_i16``, by the join: queries and references meet in cells, whatever their numbers."""
    rows = refs(spark, sf_dir)
    return knn.brute_force(queries_of(rows), rows, few=0).select("q_id", "rank", "ref_id", "d")


def knn_brute_f32(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("v"), (F.col("label") >= 5).alias("is_fraud"))
    return knn.brute_force(queries_of(e), e, exact_ints=False).select("q_id", "rank", "ref_id", F.round("d", 6).alias("d"))


def knn_vote_score(spark, sf_dir):
    rows = refs(spark, sf_dir)
    return knn.vote(knn.brute_force(queries_of(rows), rows))


def knn_response_json(spark, sf_dir):
    return knn.responses(knn_vote_score(spark, sf_dir))


def nearest_centroid_assign(spark, sf_dir):
    return assigned(refs(spark, sf_dir)).select("ref_id", "cluster_id", F.col("dist_sq").alias("d"))


def half_norm_scores(spark, sf_dir):
    rows = refs(spark, sf_dir)
    found = assigned(rows).join(F.broadcast(starts(rows)), "cluster_id")
    return found.select("ref_id", "cluster_id", vectors.score(F.col("v"), F.col("centroid")).alias("score"), vectors.norm_sq(F.col("v")).alias("norm_sq"))


def cluster_counts_starts(spark, sf_dir):
    return index.cluster_counts(assigned(refs(spark, sf_dir)), CLUSTERS).select("cluster_id", "row_count", "row_start")


def cluster_block_starts(spark, sf_dir):
    return index.cluster_counts(assigned(refs(spark, sf_dir)), CLUSTERS).select("cluster_id", "n_blocks", "block_start")


def cluster_bbox(spark, sf_dir):
    boxes = index.cluster_boxes(assigned(refs(spark, sf_dir)), 64, "v")
    return boxes.select("cluster_id", F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "b")).select("cluster_id", "dim", "b.lo", "b.hi")


def _bounds(rows: DataFrame) -> DataFrame:
    """q_id, cluster_id, d, lb of every query and cluster with rows; the clusters are at most CLUSTERS rows."""
    boxes = index.cluster_boxes(assigned(rows), 64, "v").join(F.broadcast(starts(rows)), "cluster_id")
    few = F.broadcast(boxes.agg(F.collect_list(F.struct("cluster_id", "centroid", "lo", "hi")).alias("c")))
    each = queries_of(rows).join(few).select("q_id", "v", F.explode("c").alias("c"))
    return each.select("q_id", "c.cluster_id", vectors.l2_sq(F.col("v"), F.col("c.centroid")).alias("d"), vectors.bbox_lower_bound_sq(F.col("v"), F.col("c.lo"), F.col("c.hi")).alias("lb"))


def bbox_lower_bound(spark, sf_dir):
    return _bounds(refs(spark, sf_dir)).select("q_id", "cluster_id", "lb")


def probe_nearest_cluster(spark, sf_dir):
    return _bounds(refs(spark, sf_dir)).groupBy("q_id").agg(F.min(F.struct("d", "cluster_id")).alias("m")).select("q_id", "m.cluster_id", "m.d")


def repair_top8_clusters(spark, sf_dir):
    bounds = _bounds(refs(spark, sf_dir))
    best = bounds.groupBy("q_id").agg(F.min(F.struct("d", "cluster_id")).alias("m")).select("q_id", F.col("m.cluster_id").alias("probed"))
    others = bounds.join(best, "q_id").filter("cluster_id <> probed").select("q_id", F.col("cluster_id").alias("ref_id"), "lb")
    return knn.top_k(others, ivf.CAP, "lb").select("q_id", F.col("ref_id").alias("cluster_id"), "lb", "rank")


def ivf_exact_topk(spark, sf_dir):
    rows = refs(spark, sf_dir)
    return ivf.search(queries_of(rows), start_index(rows)).select("q_id", "rank", "ref_id", "d")


def ivf_join_cells(spark, sf_dir):
    """As ``ivf_exact_topk``, by the join: queries meet the references of their clusters in cells."""
    rows = refs(spark, sf_dir)
    return ivf.search(queries_of(rows), start_index(rows), few=0).select("q_id", "rank", "ref_id", "d")


def ivf_elimination(spark, sf_dir):
    """How many references of the refining clusters half of the dimensions rule out."""
    rows = refs(spark, sf_dir)
    return ivf.elimination(queries_of(rows), start_index(rows))


def ivf_capped_topk(spark, sf_dir):
    rows = refs(spark, sf_dir)
    return ivf.search(queries_of(rows), start_index(rows), "capped", cap=CAPPED).select("q_id", "rank", "ref_id", "d")


def ivf_pruning(spark, sf_dir):
    rows = refs(spark, sf_dir)
    return ivf.search_cost(queries_of(rows), start_index(rows))


def index_write_load(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("v"), (F.col("label") >= 5).alias("is_fraud"))
    path = new_path(spark, "index")
    index.write(e, path, CLUSTERS)
    back = index.dequantized(index.load(spark, path, CLUSTERS))
    return back.select("ref_id", "is_fraud", F.posexplode("v").alias("dim", "x")).select("ref_id", "is_fraud", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


def index_header_checks(spark, sf_dir):
    """n and what loading says of the embeddings' index, as it is and with another header or expectation."""
    path, rows = new_path(spark, "index"), refs(spark, sf_dir)
    own = kmeans.assign_sql(rows, starts(rows)).select("ref_id", F.col("v").cast("array<smallint>").alias("q"), "is_fraud", "cluster_id")
    centroids = np.array([r["centroid"] for r in starts(rows).orderBy("cluster_id").collect()], float) / vectors.SCALE
    index.save(own, centroids, path, len(centroids))
    manifest = written(spark.read.parquet(f"{path}/manifest"), "manifest")
    n = manifest.first()["n"]

    def said(**asked) -> str:
        try:
            return f"{index.load(spark, asked.pop('path', path), **asked).refs.count()} rows"
        except index.IndexError_ as e:
            return type(e).__name__

    found = [("as it is", said(k=CLUSTERS)), ("other k", said(k=CLUSTERS + 1)), ("other scale", said(scale=8192))]
    for name, change in (("magic", {"magic": F.lit("zero")}), ("version 0", {"format_version": F.lit(0)}), ("version 99", {"format_version": F.lit(99)})):
        other = new_path(spark, "index")
        manifest.withColumns(change).write.parquet(f"{other}/manifest")
        found.append((name, said(path=other)))
    manifest.withColumn("n", F.col("n") + 1).write.mode("overwrite").parquet(f"{path}/manifest")
    found.append(("one more row", said()))
    return spark.createDataFrame([(n, *f) for f in found], "n bigint, header string, said string")


def kmeans_lloyd_step(spark, sf_dir):
    return kmeans.lloyd_sums(assigned(refs(spark, sf_dir)))


def kmeans_fast(spark, sf_dir):
    rows = refs(spark, sf_dir)
    centroids = kmeans.kmeans_fast(rows, CLUSTERS)
    return kmeans.assign(rows, centroids).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dist_sq"), 0).alias("inertia"))


def kmeans_steps(spark, sf_dir):
    """The centroids after ``STEPS`` steps of the fast k-means."""
    centroids = kmeans.kmeans_fast(refs(spark, sf_dir), CLUSTERS, iterations=STEPS)
    rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster_id int, c array<double>")
    return rows.select("cluster_id", F.posexplode("c").alias("dim", "x")).withColumn("x", F.round("x", 4))


def kmeans_plus_plus(spark, sf_dir):
    rows = refs(spark, sf_dir)
    centroids = kmeans.kmeans_plus_plus(rows, 8)
    return kmeans.assign(rows, centroids).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dist_sq"), 0).alias("inertia"))


def kmeanspp_min_d2(spark, sf_dir):
    rows = refs(spark, sf_dir)
    return kmeans.min_distances(rows, starts(rows))


def inverse_cdf_pick(spark, sf_dir):
    rows = refs(spark, sf_dir)
    return kmeans.inverse_cdf_pick(kmeans.min_distances(rows, starts(rows)), 0.5)


def label_bitset_pack(spark, sf_dir):
    return index.label_words(refs(spark, sf_dir))


def label_bitset_get(spark, sf_dir):
    rows = refs(spark, sf_dir)
    words = index.label_words(rows)
    at = F.floor(F.col("ref_id") / 64).cast("bigint")
    return rows.withColumn("word_id", at).join(words, "word_id").select("ref_id", vectors.bit_at(F.col("word"), F.col("ref_id")).alias("is_fraud"))


def confusion_counts(spark, sf_dir):
    rows = refs(spark, sf_dir)
    truth = rows.select(F.col("ref_id").alias("q_id"), (~F.col("is_fraud")).alias("expected_approved"))
    return evaluate.confusion(knn.vote(knn.brute_force(queries_of(rows), rows)).join(truth, "q_id")).withColumn("accuracy", F.round("accuracy", 6))


def recall_at_5(spark, sf_dir):
    rows = refs(spark, sf_dir)
    own = queries_of(rows)
    return evaluate.recall(ivf.search(own, start_index(rows), "capped", cap=CAPPED), knn.brute_force(own, rows)).withColumn("recall", F.round("recall", 6))


def stride_sample(spark, sf_dir):
    return sampling.stride_sample(table(spark, sf_dir, "embeddings"), "vec_id", 100).select("sample", "vec_id")


def hash_sample(spark, sf_dir):
    return sampling.hash_sample(table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey")


def reference_files(spark, sf_dir):
    """What is read back from the embeddings as reference records in several files, plain and gzipped: numbers follow the files."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), (F.col("label") >= 5).alias("is_fraud"))
    e = e.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").drop("vec_id")
    out = []
    for kind in (None, "gzip"):
        path = new_path(spark, "references")
        references.write_references(e, path, kind)
        out.append(references.read_references(spark, path, 64).withColumn("kind", F.lit(kind or "plain")))
    return out[0].union(out[1]).select("kind", "ref_id", "is_fraud", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


def stream_score(spark, sf_dir):
    """The votes of ``knn_vote_score``, by a stream of the embeddings."""
    rows = refs(spark, sf_dir)
    source = table(spark, sf_dir, "embeddings")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/embeddings.parque[t]")
    asked = stream.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), vectors.quantize(F.col("embedding")).alias("v"))
    path = new_path(spark, "scores")
    score.score_stream(asked, score.scorer(rows), path, new_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


QUERIES = {
    f.__name__: f
    for f in (
        quantize_vectors, dequantize_vectors, knn_brute_i16, knn_join_cells, knn_brute_f32, knn_vote_score, knn_response_json, nearest_centroid_assign, half_norm_scores,
        cluster_counts_starts, cluster_block_starts, cluster_bbox, bbox_lower_bound, probe_nearest_cluster, repair_top8_clusters, ivf_exact_topk,
        ivf_join_cells, ivf_elimination, ivf_capped_topk, ivf_pruning, index_write_load, index_header_checks, kmeans_lloyd_step, kmeans_fast, kmeans_steps, kmeans_plus_plus, kmeanspp_min_d2, inverse_cdf_pick,
        label_bitset_pack, label_bitset_get, confusion_counts, recall_at_5, stride_sample, hash_sample, reference_files, stream_score,
    )
}

_D = "CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] - {b}[i] AS BIGINT) * ({a}[i] - {b}[i]))) AS BIGINT)"
_E = """e AS (
    SELECT vec_id AS ref_id, list_transform(embedding, lambda x: CAST(round(x * CAST(10000 AS FLOAT)) AS INTEGER)) AS v, label >= 5 AS is_fraud FROM embeddings
), q AS (
    SELECT ref_id AS q_id, v FROM e WHERE ref_id % 100 = 0
)"""
_KNN = f"""{_E}, p AS (
    SELECT q.q_id, e.ref_id, e.is_fraud, {_D.format(a="q.v", b="e.v")} AS d FROM q JOIN e ON q.q_id <> e.ref_id
), t AS (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, ref_id) AS rank FROM p QUALIFY rank <= 5
)"""
_VOTE = f"""{_KNN}, w AS (
    SELECT q_id, CAST(sum(CAST(is_fraud AS INTEGER)) AS BIGINT) AS votes, count(*) AS neighbours FROM t GROUP BY q_id
), s AS (
    SELECT q_id, votes, neighbours, votes / 5.0::DOUBLE AS fraud_score, votes < 3 AS approved FROM w
)"""
_C = f"""{_E}, pos AS (
    SELECT *, row_number() OVER (ORDER BY ref_id) - 1 AS position, count(*) OVER () AS n FROM e
), c AS (
    SELECT CAST(r.i AS INTEGER) AS cluster_id, pos.v AS centroid FROM range({CLUSTERS}) r(i) JOIN pos ON pos.position = (r.i * pos.n) // {CLUSTERS}
), a AS (
    SELECT e.ref_id, e.v, e.is_fraud, c.cluster_id, {_D.format(a="e.v", b="c.centroid")} AS d FROM e, c
    QUALIFY row_number() OVER (PARTITION BY e.ref_id ORDER BY d, c.cluster_id) = 1
), g AS (
    SELECT r.i AS cluster_id, count(a.ref_id) AS row_count FROM range({CLUSTERS}) r(i) LEFT JOIN a ON a.cluster_id = r.i GROUP BY r.i
)"""
_B = f"""{_C}, x AS (
    SELECT cluster_id, k, min(v[k]) AS lo, max(v[k]) AS hi FROM a, range(1, 65) d(k) GROUP BY cluster_id, k
), lb AS (
    SELECT q_id, cluster_id, CAST(sum(CAST(greatest(0, lo - v[k], v[k] - hi) AS BIGINT) * greatest(0, lo - v[k], v[k] - hi)) AS BIGINT) AS lb
    FROM q, x GROUP BY q_id, cluster_id
), b AS (
    SELECT lb.q_id, lb.cluster_id, lb.lb, {_D.format(a="q.v", b="c.centroid")} AS d FROM lb JOIN q USING (q_id) JOIN c USING (cluster_id)
), probe AS (
    SELECT q_id, cluster_id, d FROM b QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY d, cluster_id) = 1
), repair AS (
    SELECT b.q_id, b.cluster_id, b.lb, CAST(row_number() OVER (PARTITION BY b.q_id ORDER BY b.lb, b.cluster_id) AS INTEGER) AS rank
    FROM b JOIN probe USING (q_id) WHERE b.cluster_id <> probe.cluster_id
)"""
_CAPPED = f"""{_B}, cand AS (
    SELECT q_id, cluster_id FROM probe UNION ALL SELECT q_id, cluster_id FROM repair WHERE rank <= {CAPPED}
), cp AS (
    SELECT q.q_id, a.ref_id, {_D.format(a="q.v", b="a.v")} AS d FROM cand JOIN q USING (q_id) JOIN a USING (cluster_id) WHERE a.ref_id <> q.q_id
), ct AS (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, ref_id) AS rank FROM cp QUALIFY rank <= 5
)"""
#: Each query's worst distance in the cluster that it probes first.
_SEEDS = f"""sp AS (
    SELECT q.q_id, a.ref_id, {_D.format(a="q.v", b="a.v")} AS near FROM probe JOIN q USING (q_id) JOIN a USING (cluster_id) WHERE a.ref_id <> q.q_id
    QUALIFY row_number() OVER (PARTITION BY q.q_id ORDER BY near, a.ref_id) <= 5
), sw AS (SELECT q_id, CASE WHEN count(*) >= 5 THEN max(near) END AS worst FROM sp GROUP BY q_id)"""
_STEP = "SELECT a.cluster_id, CAST(k - 1 AS INTEGER) AS dim, CAST(sum(v[k]) AS BIGINT) AS total, count(*) AS n FROM a, range(1, 65) d(k) GROUP BY a.cluster_id, k"


def _lloyd(step: int) -> str:
    """c{step}: the centroids after one more step, in double precision; an empty cluster keeps its own."""
    d = "list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - c.centroid[i]) * (e.v[i] - c.centroid[i])))"
    return f"""a{step} AS (SELECT e.v, c.cluster_id FROM e, c{step - 1} c QUALIFY row_number() OVER (PARTITION BY e.ref_id ORDER BY {d}, c.cluster_id) = 1),
        m{step} AS (SELECT cluster_id, k, CAST(sum(v[k]) AS DOUBLE) / count(*) AS x FROM a{step}, range(1, 65) d(k) GROUP BY cluster_id, k),
        c{step} AS (SELECT c.cluster_id, list(coalesce(m.x, c.centroid[d.k]) ORDER BY d.k) AS centroid FROM c{step - 1} c CROSS JOIN range(1, 65) d(k)
            LEFT JOIN m{step} m ON m.cluster_id = c.cluster_id AND m.k = d.k GROUP BY c.cluster_id)"""


_TOP = "SELECT q_id, CAST(rank AS INTEGER) AS rank, ref_id, d FROM {t}"
_BIT = "CASE WHEN ref_id % 64 = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(ref_id % 64 AS INTEGER) END"

ORACLE_SQL = {
    "quantize_vectors": f"WITH {_E} SELECT ref_id AS vec_id, CAST(k - 1 AS INTEGER) AS dim, v[k] AS q FROM e, range(1, 65) d(k)",
    "dequantize_vectors": f"WITH {_E} SELECT ref_id AS vec_id, CAST(k - 1 AS INTEGER) AS dim, round(CAST(CAST(v[k] AS FLOAT) * CAST(0.0001 AS FLOAT) AS DOUBLE), 6) AS x FROM e, range(1, 65) d(k)",
    "knn_brute_i16": f"WITH {_KNN} {_TOP.format(t='t')}",
    "knn_brute_f32": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (
        SELECT a.vec_id AS q_id, b.vec_id AS ref_id, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS d
        FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY d, ref_id) AS INTEGER) AS rank, ref_id, round(d, 6) AS d FROM p QUALIFY rank <= 5""",
    "knn_vote_score": f"WITH {_VOTE} SELECT * FROM s",
    "knn_response_json": f"""WITH {_VOTE} SELECT q_id, '{{"approved":' || approved || ',"fraud_score":' || fraud_score || '}}' AS response FROM s""",
    "nearest_centroid_assign": f"WITH {_C} SELECT ref_id, cluster_id, d FROM a",
    "half_norm_scores": f"""WITH {_C}, s AS (SELECT e.ref_id, c.cluster_id,
        CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(2 * e.v[i] - c.centroid[i] AS BIGINT) * c.centroid[i])) AS BIGINT) AS score,
        CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(e.v[i] AS BIGINT) * e.v[i])) AS BIGINT) AS norm_sq FROM e, c)
        SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, cluster_id) = 1""",
    "cluster_counts_starts": f"WITH {_C} SELECT CAST(cluster_id AS INTEGER) AS cluster_id, row_count, CAST(coalesce(sum(row_count) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_start FROM g",
    "cluster_block_starts": f"WITH {_C} SELECT CAST(cluster_id AS INTEGER) AS cluster_id, (row_count + 7) // 8 AS n_blocks, CAST(coalesce(sum((row_count + 7) // 8) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_start FROM g",
    "cluster_bbox": f"WITH {_C} SELECT cluster_id, CAST(k - 1 AS INTEGER) AS dim, min(v[k]) AS lo, max(v[k]) AS hi FROM a, range(1, 65) d(k) GROUP BY cluster_id, k",
    "bbox_lower_bound": f"WITH {_B} SELECT q_id, cluster_id, lb FROM b",
    "probe_nearest_cluster": f"WITH {_B} SELECT q_id, cluster_id, d FROM probe",
    "repair_top8_clusters": f"WITH {_B} SELECT q_id, cluster_id, lb, rank FROM repair WHERE rank <= 8",
    # The exact search must give what brute force gives.
    "ivf_exact_topk": f"WITH {_KNN} {_TOP.format(t='t')}",
    "knn_join_cells": f"WITH {_KNN} {_TOP.format(t='t')}",
    "ivf_join_cells": f"WITH {_KNN} {_TOP.format(t='t')}",
    "ivf_elimination": f"""WITH {_B}, {_SEEDS}, dims AS (SELECT k, row_number() OVER (ORDER BY CAST(count(*) AS HUGEINT) * sum(CAST(v[k] AS BIGINT) * v[k]) - CAST(sum(v[k]) AS HUGEINT) * sum(v[k]) DESC, k) AS place FROM e, range(1, 65) d(k) GROUP BY k),
        half AS (SELECT list(k) AS ks FROM dims WHERE place <= 32), r AS (
        SELECT repair.q_id, worst, CAST(list_sum(list_transform(ks, lambda i: CAST(q.v[i] - a.v[i] AS BIGINT) * (q.v[i] - a.v[i]))) AS BIGINT) AS part
        FROM repair JOIN sw USING (q_id) JOIN q USING (q_id) JOIN a ON a.cluster_id = repair.cluster_id AND a.ref_id <> q.q_id, half WHERE worst IS NULL OR repair.lb <= worst)
        SELECT q.q_id, count(r.q_id) AS compared, count(*) FILTER (part > worst) AS dropped FROM q LEFT JOIN r USING (q_id) GROUP BY q.q_id""",
    "ivf_capped_topk": f"WITH {_CAPPED} {_TOP.format(t='ct')}",
    "ivf_pruning": f"""WITH {_B}, {_SEEDS}
    SELECT q.q_id, count(r.cluster_id) AS refined FROM q LEFT JOIN sw USING (q_id) LEFT JOIN repair r ON r.q_id = q.q_id AND (worst IS NULL OR r.lb <= worst) GROUP BY q.q_id""",
    "index_write_load": f"WITH {_E} SELECT ref_id, is_fraud, CAST(k - 1 AS INTEGER) AS dim, round(CAST(CAST(v[k] AS FLOAT) * CAST(0.0001 AS FLOAT) AS DOUBLE), 6) AS x FROM e, range(1, 65) d(k)",
    "index_header_checks": """WITH e AS (SELECT count(*) AS n FROM embeddings)
        SELECT n, unnest(['as it is', 'other k', 'other scale', 'magic', 'version 0', 'version 99', 'one more row']) AS header,
        unnest([n || ' rows', 'UnsupportedKClusters', 'UnsupportedFixScale', 'BadMagic', 'UnsupportedVersion', 'UnsupportedVersion', 'Truncated']) AS said FROM e""",
    "kmeans_lloyd_step": f"WITH {_C} {_STEP}",
    "kmeans_steps": f"WITH {_C}, c0 AS (SELECT cluster_id, list_transform(centroid, lambda x: CAST(x AS DOUBLE)) AS centroid FROM c), "
    + ", ".join(map(_lloyd, range(1, STEPS + 1)))
    + f" SELECT cluster_id, CAST(k - 1 AS INTEGER) AS dim, round(centroid[k], 4) AS x FROM c{STEPS}, range(1, 65) d(k)",
    "kmeanspp_min_d2": f"WITH {_C} SELECT ref_id, d AS min_d2 FROM a",
    "inverse_cdf_pick": f"""WITH {_C}, r AS (SELECT ref_id, d AS min_d2, CAST(sum(d) OVER (ORDER BY ref_id) AS BIGINT) AS running, sum(d) OVER () AS total FROM a)
        SELECT ref_id, min_d2, running FROM r WHERE running >= 0.5 * total ORDER BY ref_id LIMIT 1""",
    "label_bitset_pack": f"WITH {_E} SELECT ref_id // 64 AS word_id, bit_or(CASE WHEN is_fraud THEN {_BIT} ELSE 0 END) AS word FROM e GROUP BY 1",
    "label_bitset_get": f"WITH {_E} SELECT ref_id, is_fraud FROM e",
    "confusion_counts": f"""WITH {_VOTE}, j AS (SELECT s.approved AS a, NOT e.is_fraud AS x FROM s JOIN e ON e.ref_id = s.q_id)
        SELECT count(*) AS total, count(*) FILTER (x AND a) AS approved_right, count(*) FILTER (NOT x AND NOT a) AS denied_right, count(*) FILTER (NOT x AND a) AS approved_wrong,
        count(*) FILTER (x AND NOT a) AS denied_wrong, count(*) FILTER (a IS NULL) AS errors, round(count(*) FILTER (x = a) / count(*), 6) AS accuracy FROM j""",
    "recall_at_5": f"""WITH {_CAPPED}, p AS (SELECT q.q_id, e.ref_id, {_D.format(a="q.v", b="e.v")} AS d FROM q JOIN e ON q.q_id <> e.ref_id
        QUALIFY row_number() OVER (PARTITION BY q.q_id ORDER BY d, e.ref_id) <= 5)
        SELECT count(ct.ref_id) AS hits, count(*) AS wanted, round(count(ct.ref_id) / count(*), 6) AS recall FROM p LEFT JOIN ct ON ct.q_id = p.q_id AND ct.ref_id = p.ref_id""",
    "stride_sample": "WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS position, count(*) OVER () AS n FROM embeddings) SELECT r.i AS sample, vec_id FROM range(100) r(i) JOIN p ON p.position = (r.i * p.n) // 100",
    "reference_files": """WITH k(kind) AS (VALUES ('plain'), ('gzip')), e AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS ref_id FROM embeddings)
        SELECT kind, ref_id, label >= 5 AS is_fraud, CAST(d - 1 AS INTEGER) AS dim, round(CAST(embedding[d] AS DOUBLE), 6) AS x FROM e, range(1, 65) r(d), k""",
    "stream_score": f"WITH {_VOTE} SELECT * FROM s",
}
