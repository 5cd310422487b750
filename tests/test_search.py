import numpy as np
import pyarrow as pa
import pytest

from vicinal.functions.vectors import SCALE
from vicinal.operators import index, ivf, kmeans, knn


def frame(spark, vectors, fraud=None):
    return spark.createDataFrame([(i, [int(x) for x in v], bool(fraud[i]) if fraud is not None else i % 3 == 0) for i, v in enumerate(vectors)], "ref_id bigint, v array<int>, is_fraud boolean")


def asked(spark, vectors, first=-1):
    return spark.createDataFrame([(first - i, [int(x) for x in v]) for i, v in enumerate(vectors)], "q_id bigint, v array<int>")


def naive(q, refs, k=5):
    d = ((refs.astype(np.int64) - np.asarray(q, np.int64)) ** 2).sum(axis=1)
    order = np.lexsort((np.arange(len(refs)), d))[:k]
    return [(int(i), int(d[i])) for i in order]


def got(found):
    out = {}
    for r in found.orderBy("q_id", "rank").collect():
        out.setdefault(r["q_id"], []).append((r["ref_id"], r["d"]))
    return out


def built(spark, refs, k, centroids=None):
    rows = frame(spark, refs)
    if centroids is None:
        centroids = kmeans.kmeans_fast(rows, k, iterations=3)
    own = kmeans.assign(rows, centroids).selectExpr("ref_id", "v as q", "is_fraud", "cluster_id")
    return index.Index(own, index.cluster_meta(own, len(centroids), refs.shape[1]), np.asarray(centroids) / SCALE, refs.shape[1])


@pytest.mark.parametrize("cos", [[1, 0.9, 0.5, 0, -1], [(9 - i) / 9 for i in range(10)]])
def test_unit_rows_come_in_order_of_their_angle(spark, cos):
    refs = np.zeros((len(cos), 14))
    refs[:, 0], refs[:, 1] = cos, np.sqrt(1 - np.array(cos) ** 2)
    found = got(knn.brute_force(asked(spark, [np.eye(14)[0] * SCALE]), frame(spark, np.rint(refs * SCALE))))
    assert [r for r, _ in found[-1]] == [0, 1, 2, 3, 4]


def test_brute_force_is_naive_with_ties_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(0)
    refs = rng.integers(0, 3, (700, 4))
    queries = rng.integers(0, 3, (9, 4))
    monkeypatch.setattr(knn, "CELL_ROWS", 40)
    for few in (100, 8, 0):  # sent to all tasks, or joined in cells
        found = got(knn.brute_force(asked(spark, queries), frame(spark, refs).repartition(7), few=few))
        assert found == {-1 - i: naive(q, refs) for i, q in enumerate(queries)}


def test_the_join_sends_no_query_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(1)
    refs, queries = rng.integers(0, 50, (900, 6)), rng.integers(0, 50, (300, 6))
    monkeypatch.setattr(knn, "CELL_ROWS", 100)
    asked_, frame_ = asked(spark, queries), frame(spark, refs)
    for name in ("toArrow", "toPandas", "collect", "toLocalIterator"):
        monkeypatch.setattr(type(asked_), name, lambda *a: pytest.fail("rows came to the driver"))
    joined = knn.brute_force(asked_, frame_, few=0)
    plan = joined._jdf.queryExecution().toString()
    monkeypatch.undo()
    assert "FlatMapCoGroupsInArrow" in plan
    assert got(joined) == {-1 - i: naive(q, refs) for i, q in enumerate(queries)}


@pytest.mark.parametrize("exact", [True, False])
def test_half_of_the_dimensions_rule_out_most_pairs_and_lose_none(exact):
    rng = np.random.default_rng(2)
    wide = np.array([900] * 4 + [5] * 10)
    refs, queries = (rng.integers(-1, 2, (n, 14)) * wide + rng.integers(0, 40, (n, 14)) for n in (6000, 30))
    refs, queries = refs / (1 if exact else 7), queries / (1 if exact else 7)
    lists = knn.Lists(np.arange(-30, 0), queries, 5, exact)
    lists.add(np.arange(30), np.arange(6000), refs, np.zeros(6000, bool))
    assert set(lists.order[:4].tolist()) == {0, 1, 2, 3}
    found = {}
    for row in pa.Table.from_batches(lists.batches()).to_pylist():
        found.setdefault(row["q_id"], []).append((row["d"], row["ref_id"]))
    for i, q in enumerate(queries):
        d = ((refs - q) ** 2).sum(axis=1)
        assert [r for _, r in sorted(found[i - 30])] == np.lexsort((np.arange(6000), d))[:5].tolist()
    assert lists.pairs == 30 * 6000 and lists.dropped > 0.6 * lists.pairs


def test_a_worst_distance_keeps_ties_and_leaves_out_the_rest(spark):
    rows = spark.createDataFrame([(-1, [0, 0], 4), (-2, [0, 0], None)], "q_id bigint, v array<int>, worst bigint")
    refs = frame(spark, np.array([[2, 0], [0, 2], [2, 1], [3, 3], [9, 9], [1, 0]]))
    for few in (10, 0):
        found = got(knn.top_k(knn.nearest(rows, refs, few=few)))
        assert found == {-1: [(5, 1), (0, 4), (1, 4)], -2: [(5, 1), (0, 4), (1, 4), (2, 5), (3, 18)]}


def test_pruned_counts(spark):
    rng = np.random.default_rng(5)
    refs = rng.integers(0, SCALE, (500, 8)) * np.array([1, 1, 1, 1, 0.1, 0.1, 0.1, 0.1])
    refs = refs.astype(int)
    queries = refs[:7] + 3
    at = built(spark, refs, 10)
    assert ivf.spread(at.refs).tolist() == np.lexsort((np.arange(8), -refs.var(axis=0))).tolist()
    half = ivf.spread(at.refs)[:4]
    s = ivf.Search(asked(spark, queries), at)
    worst = {r["q_id"]: r["m"] for r in s.seed.groupBy("q_id").agg({"d": "max"}).withColumnRenamed("max(d)", "m").collect()}
    chosen = {}
    for r in s.selected.collect():
        chosen.setdefault(r["q_id"], set()).add(r["cluster_id"])
    cluster = {r["ref_id"]: r["cluster_id"] for r in at.refs.collect()}
    want = {}
    for i, q in enumerate(queries):
        own = [j for j in range(500) if cluster[j] in chosen.get(-1 - i, ())]
        want[-1 - i] = len(own), sum(int(((refs[j][half] - q[half]) ** 2).sum()) > worst[-1 - i] for j in own)
    assert {r["q_id"]: (r["compared"], r["dropped"]) for r in ivf.elimination(asked(spark, queries), at).collect()} == want
    assert sum(d for _, d in want.values()) > 0


def test_fewer_rows_than_k_and_none(spark):
    refs = np.array([[1, 2], [3, 4]])
    votes = knn.vote(knn.brute_force(asked(spark, [[0, 0]]), frame(spark, refs, [True, True]))).first()
    assert (votes["votes"], votes["neighbours"], votes["fraud_score"], votes["approved"]) == (2, 2, 0.4, True)
    assert knn.brute_force(asked(spark, [[0, 0]]), frame(spark, refs).limit(0)).count() == 0
    assert knn.brute_force(asked(spark, [[0, 0]]).limit(0), frame(spark, refs)).count() == 0


@pytest.mark.parametrize("votes", range(6))
def test_votes_and_responses(spark, votes):
    rows = spark.createDataFrame([(1, i, i, i < votes, i) for i in range(5)], "q_id bigint, ref_id bigint, d bigint, is_fraud boolean, rank int")
    answer = knn.responses(knn.vote(rows)).first()["response"]
    assert answer == '{"approved":%s,"fraud_score":%s}' % (str(votes <= 2).lower(), votes / 5)


def test_two_clusters(spark):
    refs = np.zeros((10, 14))
    refs[:5, 0], refs[5:, 1] = SCALE, SCALE
    refs[:5, 2] = refs[5:, 3] = np.arange(5) * 10
    for mode in ivf.MODES:
        found = got(ivf.search(asked(spark, [np.eye(14)[0] * SCALE]), built(spark, refs, 2), mode))
        assert [r for r, _ in found[-1]] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("kind", ["uniform", "clustered", "ties"])
def test_exact_search_is_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    refs = {
        "uniform": lambda: rng.integers(0, SCALE, (800, 14)),
        "clustered": lambda: (rng.integers(0, SCALE, (20, 14))[rng.integers(0, 20, 800)] + rng.normal(0, 100, (800, 14))).astype(int),
        "ties": lambda: rng.integers(0, 2, (800, 14)) * 100,
    }[kind]()
    queries = refs[rng.integers(0, 800, 12)] + rng.integers(-50, 50, (12, 14)) * (kind != "ties")
    at = built(spark, refs, 16)
    for few in (100, 0):
        assert got(ivf.search(asked(spark, queries), at, few=few)) == {-1 - i: naive(q, refs) for i, q in enumerate(queries)}


def test_capped_search_is_its_set_definition_and_may_miss(spark):
    rng = np.random.default_rng(4)
    refs, queries = rng.integers(0, SCALE, (600, 14)), rng.integers(0, SCALE, (20, 14))
    at = built(spark, refs, 24)
    meta = {r["cluster_id"]: r for r in at.meta.collect() if r["row_count"]}
    cluster = {r["ref_id"]: r["cluster_id"] for r in at.refs.collect()}
    want, missed = {}, 0
    for i, q in enumerate(queries):
        near = min(meta, key=lambda c: (((at.centroids[c] * SCALE - q) ** 2).sum(), c))
        bound = {c: int((np.maximum(0, np.maximum(np.array(m["lo"], int) - q, q - np.array(m["hi"], int))) ** 2).sum()) for c, m in meta.items()}
        chosen = {near, *sorted((c for c in meta if c != near), key=lambda c: (bound[c], c))[:2]}
        ids = np.array([r for r in range(len(refs)) if cluster[r] in chosen])
        want[-1 - i] = [(int(ids[j]), d) for j, d in naive(q, refs[ids])]
        missed += want[-1 - i] != naive(q, refs)
    assert got(ivf.search(asked(spark, queries), at, "capped", cap=2)) == want
    assert missed > 0


def test_one_cluster_empty_clusters_and_few_rows(spark):
    refs = np.array([[0, 0], [5, 5], [9, 9]])
    for centroids in ([[4, 4]], [[0, 0], [1000, 1000], [9, 9]]):
        found = got(ivf.search(asked(spark, [[1, 1]]), built(spark, refs, 0, np.array(centroids, float))))
        assert found[-1] == naive([1, 1], refs)


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="mode"):
        ivf.search(asked(spark, [[1, 1]]), None, "fast")
