import numpy as np
import pytest

from vicinal.operators import kmeans, sampling


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "ref_id bigint, v array<double>")


def lloyd(x, k, iterations):
    c = x[[i * len(x) // k for i in range(k)]].astype(float)
    for _ in range(iterations):
        best = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[best == j].mean(axis=0) if (best == j).any() else c[j] for j in range(k)])
    return c


@pytest.mark.parametrize("method", [kmeans.kmeans_fast, kmeans.kmeans_plus_plus])
def test_two_attractors(spark, method):
    x = np.array([[0, 0], [0.01, 0], [0, 0.01], [1, 1], [0.99, 1], [1, 0.99]])
    c = method(frame(spark, x), 2, iterations=20)
    assert sorted(c.round(1).tolist()) == [[0, 0], [1, 1]]


def test_fast_is_lloyd_and_repeats(spark):
    x = np.random.default_rng(5).uniform(size=(200, 3))
    a, b = (kmeans.kmeans_fast(frame(spark, x).repartition(n), 7, iterations=6) for n in (1, 5))
    np.testing.assert_allclose(a, lloyd(x, 7, 6), atol=1e-9)
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_plus_plus_repeats(spark):
    x = np.random.default_rng(6).uniform(size=(60, 3))
    a, b = (kmeans.kmeans_plus_plus(frame(spark, x), 4, seed=9, iterations=3) for _ in range(2))
    np.testing.assert_allclose(a, b)


def test_empty_clusters_give_no_nan(spark):
    x = np.array([[0.0, 0.0]] * 4)
    for method in (kmeans.kmeans_fast, kmeans.kmeans_plus_plus):
        assert not np.isnan(method(frame(spark, x), 4, iterations=3)).any()


def test_assignment_takes_the_lowest_of_equals(spark):
    x, c = np.eye(7), np.vstack([np.eye(7)[:3]])
    got = [r["cluster_id"] for r in kmeans.assign(frame(spark, x), c).orderBy("ref_id").collect()]
    assert got == [0, 1, 2, 0, 0, 0, 0]


def test_k_is_checked(spark):
    with pytest.raises(ValueError, match="k must"):
        kmeans.kmeans_fast(frame(spark, np.eye(2)), 0)


def test_positions_and_strides(spark):
    ids = [7, 3, 900, 12, 5, 44, -2]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = {r["id"]: r["position"] for r in sampling.with_position(rows, "id").collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}
    for size in (1, 3, 7, 50):
        picked = {r["sample"]: r["id"] for r in sampling.stride_sample(rows, "id", size).collect()}
        n = min(size, 7)
        assert picked == {i: sorted(ids)[i * 7 // n] for i in range(n)}
    assert sampling.stride_sample(rows.limit(0), "id", 3).count() == 0


def test_hash_sample_repeats(spark):
    rows = spark.range(100)
    a, b = (sorted(r["id"] for r in sampling.hash_sample(rows.repartition(n), "id", 10).collect()) for n in (1, 6))
    assert a == b and len(a) == 10 and sampling.hash_sample(rows, "id", 500).count() == 100
