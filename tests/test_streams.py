"""Streams against their batch forms, with restarts, repeats and bounds."""

import numpy as np
import pytest
from test_search import asked, frame, naive

from vicinal.operators import evaluate, knn
from vicinal.streaming import intake, metrics, score, state, topk


def shown(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_a_restarted_stream_reports_what_the_batch_does(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"h{i % 3}", int(v)) for i, v in enumerate(rng.integers(0, 1 << 40, 600))] + [("h0", 0), ("c1", None), ("c1", None), ("c2", None)]
    paths = [str(tmp_path / n) for n in ("in", "out", "checkpoint")]
    for part in range(4):
        spark.createDataFrame(rows[part::4], "name string, value bigint").write.mode("append").parquet(paths[0])
        query = metrics.metrics_stream(spark.readStream.schema("name string, value bigint").parquet(paths[0]), *paths[1:])
        query.awaitTermination()
    whole = metrics.observed(spark.createDataFrame(rows, "name string, value bigint"))
    assert shown(metrics.report(metrics.last_state(spark, paths[1]))) == shown(metrics.report(whole))
    assert {p.name for p in (tmp_path / "out").glob("batch=*")} == {"batch=1", "batch=2", "batch=3"}
    lines = [r["value"] for r in metrics.report(whole).collect()]
    assert "c1 2" in lines and len(lines) == 2 + 2 * 3


def test_an_interrupted_batch_counts_once(spark, tmp_path, monkeypatch):
    """A batch that fails while it is written is run again from the checkpoint."""
    spark.createDataFrame([("a", 3), ("a", 5)], "name string, value bigint").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("name string, value bigint").parquet(str(tmp_path / "in"))
    monkeypatch.setattr(metrics, "observed", lambda o, whole=metrics.observed: whole(o).selectExpr("name", "bucket", "n", "if(n > 0, raise_error('lost'), total) as total", "most"))
    with pytest.raises(Exception, match="lost"):
        metrics.metrics_stream(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    monkeypatch.undo()
    metrics.metrics_stream(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sum(r["n"] for r in metrics.last_state(spark, str(tmp_path / "out")).collect()) == 2


def test_rates_go_on_after_restarts_and_leave_out_repeats(spark, tmp_path):
    rng = np.random.default_rng(2)
    kinds = "instance string, zone int, sec bigint, requests bigint, errors bigint, clicks bigint"
    rows = []
    for name in ("a", "b", "c"):
        upto = np.cumsum(rng.integers(0, 50, (12, 3)), axis=0)
        rows += [(name, 1, 100 + 10 * i, *map(int, upto[i])) for i in range(12)]
    paths = [str(tmp_path / n) for n in ("in", "out", "checkpoint")]
    for part in range(3):
        own = [r for r in rows if (r[2] - 100) // 40 == part]
        again = [r for r in rows if (r[2] - 100) // 40 == part - 1]  # what came before comes again
        spark.createDataFrame(own[::-1] + again, kinds).write.mode("append").parquet(paths[0])
        found = state.rates(spark.readStream.schema(kinds).parquet(paths[0]), ["instance", "zone"], "sec", "requests", ["errors", "clicks"])
        state.rate_stream(found, *paths[1:]).awaitTermination()
    batch = evaluate.rates(spark.createDataFrame(rows, kinds), ["instance", "zone"], "sec", "requests", ["errors", "clicks"])
    assert shown(spark.read.parquet(paths[1]).select(*batch.columns)) == shown(batch)
    assert spark.conf.get(state.PROVIDER, None) != state.ROCKS


def test_a_fold_keeps_the_first_k_in_order(spark):
    rng = np.random.default_rng(3)
    refs, queries = rng.integers(0, 4, (300, 5)), rng.integers(0, 4, (20, 5))
    rows = asked(spark, queries)
    held = frame(spark, refs).selectExpr("collect_list(struct(ref_id, v, is_fraud)) as refs")
    for k in (1, 5):
        found = rows.join(held).select("q_id", topk.nearest(rows["q_id"], rows["v"], held["refs"], k).alias("near")).collect()
        assert {r["q_id"]: [(x["ref_id"], x["d"]) for x in r["near"]] for r in found} == {-1 - i: naive(q, refs, k) for i, q in enumerate(queries)}
    assert shown(topk.score(rows, frame(spark, refs))) == shown(knn.vote(knn.brute_force(rows, frame(spark, refs))))
    few = frame(spark, refs[:2])
    assert shown(topk.score(rows, few)) == shown(knn.vote(knn.brute_force(rows, few)))
    assert topk.score(rows, few.limit(0)).count() == 0


def test_a_stream_holds_a_bounded_number_of_references(spark, monkeypatch):
    monkeypatch.setattr(topk, "MOST_HELD", 3)
    with pytest.raises(ValueError, match="at most 3"):
        topk.score(asked(spark, [[1]]), frame(spark, np.zeros((4, 1), int)))


def test_more_references_are_folded_in_blocks(spark, tmp_path, monkeypatch):
    """A stream against more references than it may hold gives what the batch gives, ties over blocks and a request's own id included."""
    from helpers import SF

    from vicinal.plans.stream_queries import stream_topk_fold
    from vicinal.plans.vector_queries import knn_vote_score

    rng = np.random.default_rng(4)
    refs, queries = rng.integers(0, 3, (400, 5)), rng.integers(0, 3, (30, 5))
    rows, held = asked(spark, queries), frame(spark, refs)
    rows = rows.union(held.filter("ref_id < 20").selectExpr("ref_id as q_id", "v"))
    want = shown(knn.vote(knn.brute_force(rows, held)))
    monkeypatch.setattr(knn, "QUERY_SLICE", 7)
    assert shown(topk.score_blocks(rows, held, block=60)) == want
    rows.write.parquet(str(tmp_path / "in"))
    found = topk.score_blocks(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), held, block=60)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == want
    few = held.limit(2)
    assert shown(topk.score_blocks(rows, few)) == shown(knn.vote(knn.brute_force(rows, few)))
    assert topk.score_blocks(rows, held.limit(0)).count() == 0
    monkeypatch.setattr(topk, "MOST_HELD", 3)
    assert shown(stream_topk_fold(spark, SF)) == shown(knn_vote_score(spark, SF))


def test_no_batch_takes_more_than_its_bound(spark, tmp_path):
    spark.range(700).repartition(14).write.parquet(str(tmp_path / "in"))
    per_file = 700 // 14 + 8
    listener = intake.Intake()
    spark.streams.addListener(listener)
    try:
        for name, bound in (("files", {"files": 3}), ("bytes", {"size": 1200})):
            stream = intake.bounded(spark, str(tmp_path / "in"), spark.range(1).schema, **bound)
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
            query.awaitTermination()
            taken = listener.taken(query)
            assert sum(t.rows for t in taken) == 700 == spark.read.parquet(str(tmp_path / name)).distinct().count()
            assert len(taken) >= 5 and max(t.rows for t in taken) <= 3 * per_file
    finally:
        spark.streams.removeListener(listener)
    with pytest.raises(ValueError, match="bound"):
        intake.bounded(spark, str(tmp_path / "in"), spark.range(1).schema)


def test_answers_are_counted(spark):
    rows = spark.createDataFrame([(None, 2, True), (None, 4, False), ("malformed", None, None)], "reason string, votes bigint, approved boolean")
    got = sorted((r["name"], r["value"]) for r in metrics.of_answers(rows).collect() if r["value"] is not None)
    assert got == [("votes", 2), ("votes", 4)]
    assert {(r["name"], r["n"]) for r in metrics.counters(metrics.observed(metrics.of_answers(rows))).collect()} == {("req_total", 3), ("req_rejected_malformed", 1), ("req_approved", 1)}
    assert score is not None
