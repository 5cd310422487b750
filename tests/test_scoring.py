import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_features import G0, G1, G2

from vicinal.functions import vectors
from vicinal.jobs import build_index
from vicinal.operators import features, index, scoring

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """An index from reference records in a file, by the job; every third record is fraud."""
    rng = np.random.default_rng(3)
    folder = tmp_path_factory.mktemp("refs")
    rows = [{"vector": [round(float(x), 5) for x in rng.random(14)], "label": "fraud" if i % 3 == 0 else "legit"} for i in range(600)]
    (folder / "references.json").write_text(json.dumps([*rows, {"vector": [1, 2], "label": "fraud"}, {"vector": None, "label": "legit"}]))
    found = build_index.build(spark, str(folder / "references.json"), str(folder / "index"), 8, iterations=5)
    assert found == {"rows": 600, "clusters": 8, "left_out": 2}
    return index.load(spark, str(folder / "index"), 8), np.array([r["vector"] for r in rows], np.float32), np.array([i % 3 == 0 for i in range(600)])


def test_answers_against_brute_force(spark, built):
    own, refs, fraud = built
    texts = [json.dumps(x) for x in (G0, G1, G2)] + ["{}", None, json.dumps(G1).replace("5912", "59x2")]
    payloads = spark.createDataFrame([(10_000_000_000 + i, t) for i, t in enumerate(texts)], "q_id bigint, value string")
    rows = scoring.score_payloads(payloads, own).orderBy("q_id").collect()
    quantized = [np.array(r["q"]) for r in features.vectorize(payloads).filter("reason is null").select("q_id", vectors.quantize("features").alias("q")).orderBy("q_id").collect()]
    q = np.floor(np.abs(refs * np.float32(10000)) + 0.5).astype(np.int64)
    for row, v in zip(rows, quantized, strict=False):
        # Ids follow the order of the file, so ties go to the first record.
        near = np.argsort(((q - v) ** 2).sum(axis=1), kind="stable")[:5]
        votes = int(fraud[near].sum())
        assert (row["votes"], row["fraud_score"], row["approved"], row["reason"]) == (votes, votes / 5, votes <= 2, None)
        assert json.loads(row["response"]) == {"approved": votes <= 2, "fraud_score": votes / 5}
    assert [r["reason"] for r in rows[3:]] == ["missing_field", "malformed", "invalid_mcc"]
    assert [json.loads(r["response"]) for r in rows[3:]] == [{"error": "missing_field"}, {"error": "malformed"}, {"error": "invalid_mcc"}]
    assert all(r["votes"] is None and r["approved"] is None for r in rows[3:])


def test_only_the_selected_clusters_files_are_read(spark, built):
    """The references' files are pruned by the join with the selected clusters, when the query runs."""
    from vicinal.operators import ivf

    own, _, _ = built
    rows = spark.createDataFrame([(1, [0] * 14)], "q_id bigint, v array<int>")
    found = ivf.Search(rows, own)
    for few in (10, 0):
        scan = ivf.scan(found.probe, own.refs, few=few)
        scan.collect()
        plan = scan._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruningexpression(cluster_id" in plan.partition("PartitionFilters: [")[2], plan
    assert ivf.within(own.refs, found.probe).count() == own.refs.filter(f"cluster_id = {found.probe.first()['cluster_id']}").count()


def test_features_are_worked_out_before_they_are_quantized(spark):
    """Nothing of the features is inside the transform, and the reason is worked out once however it is used."""
    texts = [json.dumps(x) for x in (G0, G1, G2)] + ["{}", None, json.dumps(G1).replace("5912", "59x2"), json.dumps(G1) + " trailing"]
    payloads = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q_id bigint, value string")
    for strict in (False, True):
        want = features.vectorize(payloads, strict=strict).select("q_id", "reason", vectors.quantize("features").alias("v"))
        assert sorted(map(repr, features.quantized(payloads, strict=strict).select("q_id", "reason", "v").collect())) == sorted(map(repr, want.collect()))
    plan = features.quantized(payloads).filter("reason is null").select("q_id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("invalid_last_transaction") == 1 and "transform(features" in plan, plan


def test_splits_make_clusters_by_the_rows_and_lose_none(spark, tmp_path, monkeypatch):
    """The number of clusters follows the rows; copies, rows that the sample has not seen and ids of requests do no harm."""
    from test_search import asked, frame, got, naive

    from vicinal.operators import ivf

    assert [index.split_clusters(n) for n in (0, 1200, 1_000_000, 46_000_000, 10**12)] == [16, 17, 500, 3391, 4096]
    rng = np.random.default_rng(6)
    refs = rng.integers(0, 3, (900, 14)) * rng.integers(1, 2000, 14)
    refs[300:600] = refs[0]
    queries = np.concatenate([refs[::40] + rng.integers(-30, 30, (23, 14)), refs[:1]])
    monkeypatch.setattr(index, "SPLIT_SAMPLE", 200)
    monkeypatch.setattr(index, "FILE_ROWS", 100)
    at, rows = str(tmp_path / "index"), frame(spark, refs)
    k = index.save_split(rows, at)
    own = index.load(spark, at, k)
    assert 8 < k <= 16 and own.refs.count() == 900
    copies = {r["cluster_id"]: r["count"] for r in own.refs.groupBy("cluster_id").count().collect()}
    assert max(copies.values()) >= 300
    for few in (100, 0):
        assert got(ivf.search(asked(spark, queries), own, few=few)) == {-1 - i: naive(q, refs) for i, q in enumerate(queries)}
    assert index.save_split(rows.filter("ref_id between 300 and 400"), str(tmp_path / "copies")) == 1
    assert got(ivf.search(asked(spark, refs[:1]), index.load(spark, str(tmp_path / "copies"))))[-1] == [(i, 0) for i in range(300, 305)]


@pytest.mark.parametrize("name", ["stream_score_metrics", "payload_score_stream", "corpus_evaluation", "payload_score"])
def test_clusters_that_are_searched_follow_the_rows(spark, monkeypatch, name):
    from helpers import SF

    from vicinal.operators import ivf
    from vicinal.plans import registry

    seen = []
    monkeypatch.setattr(ivf, "Search", lambda q, own, *a, whole=ivf.Search: seen.append((own.meta.count(), own.refs.count())) or whole(q, own, *a))
    assert registry.QUERIES[name](spark, SF).count() > 0
    assert seen and all(k == index.split_clusters(n) > 16 for k, n in seen), seen


def test_corpus(spark, built):
    own, refs, fraud = built
    entries = spark.createDataFrame([(i, json.dumps(G1 | {"id": str(i)}), i < 6) for i in range(10)] + [(77, "{}", True)], "q_id bigint, value string, expected_approved boolean")
    v = np.array(features.vectorize(spark.createDataFrame([(0, json.dumps(G1))], "q_id bigint, value string")).select(vectors.quantize("features").alias("q")).first()["q"])
    q = np.floor(np.abs(refs * np.float32(10000)) + 0.5).astype(np.int64)
    approved = int(fraud[np.argsort(((q - v) ** 2).sum(axis=1), kind="stable")[:5]].sum()) <= 2
    row = scoring.evaluate_corpus(entries, own).first().asDict()
    want = {"total": 11, "errors": 1, "approved_right": 6 * approved, "denied_right": 4 * (not approved), "approved_wrong": 4 * approved, "denied_wrong": 6 * (not approved)}
    assert {k: row[k] for k in want} == want and row["accuracy"] == pytest.approx((6 if approved else 4) / 11)


def test_empty_tables(spark, built):
    own, _, _ = built
    none = spark.createDataFrame([], "q_id bigint, value string")
    assert scoring.score_payloads(none, own).count() == 0


def test_the_engine_stands_without_the_training_data_operators():
    """A subpackage whose import fails takes nothing else with it."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'payload_score' in q and not any(x.startswith('op') for x in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from vicinal import session

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Cluster)
    assert F is not None
