import numpy as np
import pytest

from vicinal.operators import index


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(-1, 1, 14)], i % 3 == 0) for i in range(100)]
    refs = spark.createDataFrame(rows, "ref_id bigint, v array<float>, is_fraud boolean")
    path = str(tmp_path_factory.mktemp("index") / "x")
    index.write(refs, path, 4, iterations=5)
    return refs, path


def test_round_trip(spark, written):
    refs, path = written
    loaded = index.load(spark, path, 4)
    meta = loaded.meta.orderBy("cluster_id").collect()
    at = blocks = 0
    for m in meta:
        assert (m["row_start"], m["block_start"], m["n_blocks"]) == (at, blocks, -(-m["row_count"] // 8))
        at, blocks = at + m["row_count"], blocks + m["n_blocks"]
    assert at == 100
    back = {r["ref_id"]: r for r in index.dequantized(loaded).collect()}
    for r in refs.collect():
        assert np.abs(np.array(back[r["ref_id"]]["v"]) - np.array(r["v"])).max() <= 1.0001 / 10000
        assert back[r["ref_id"]]["is_fraud"] == r["is_fraud"]
    q = {r["ref_id"]: r for r in loaded.refs.collect()}
    for r in q.values():
        m = meta[r["cluster_id"]]
        assert all(lo <= x <= hi for lo, x, hi in zip(m["lo"], r["q"], m["hi"], strict=True))


def test_selected_clusters_prune_partitions(spark, written):
    plan = index.load(spark, written[1]).refs.filter("cluster_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan


@pytest.mark.parametrize(
    ("change", "error"),
    [("'zero' as magic, format_version, n", index.BadMagic), *[(f"magic, {v} as format_version, n", index.UnsupportedVersion) for v in (0, 2, 7, 99)], ("magic, format_version, n + 1 as n", index.Truncated)],
)
def test_bad_manifests(spark, written, tmp_path, change, error):
    path = str(tmp_path / "copy")
    for part in ("refs", "cluster_meta", "centroids"):
        table = spark.read.parquet(f"{written[1]}/{part}")
        writer = table.write.partitionBy("cluster_id") if part == "refs" else table.write
        writer.parquet(f"{path}/{part}")
    spark.read.parquet(f"{written[1]}/manifest").selectExpr(*change.split(", "), "k_clusters", "fix_scale", "dims").write.parquet(f"{path}/manifest")
    with pytest.raises(error):
        index.load(spark, path)


def test_other_k_and_scale(spark, written):
    with pytest.raises(index.UnsupportedKClusters):
        index.load(spark, written[1], 99)
    with pytest.raises(index.UnsupportedFixScale):
        index.load(spark, written[1], 4, 8192)


def test_empty_clusters_have_empty_boxes(spark):
    rows = spark.createDataFrame([(0, [1, 2], 1)], "ref_id bigint, q array<smallint>, cluster_id int")
    meta = {r["cluster_id"]: r for r in index.cluster_meta(rows, 3, 2).collect()}
    assert meta[0]["lo"] == [32767, 32767] and meta[0]["hi"] == [-32768, -32768] and meta[0]["n_blocks"] == 0
    assert meta[1]["lo"] == meta[1]["hi"] == [1, 2] and meta[2]["row_start"] == 1
