import json

from pyspark.sql import functions as F

from vicinal.functions.scalars import log2_bucket
from vicinal.operators import evaluate
from vicinal.sources import metrics_text, payloads, references


def test_histogram_quantiles(spark):
    rows = spark.createDataFrame([("x", 2**i) for i in range(11)], "g string, v bigint")
    h = evaluate.log2_histogram(rows, ["g"], log2_bucket(F.col("v")))
    q = evaluate.histogram_quantile(h, ["g"], {"p50": 0.5, "p99": 0.99}).first()
    assert h.agg(F.sum("n")).first()[0] == 11 and q["p99"] >= 1024
    assert evaluate.histogram_quantile(h.limit(0), ["g"], {"p50": 0.5}).count() == 0


def test_nearest_rank_with_ties_and_nulls(spark):
    values = [5, 1, 1, 1, 9, 7, None, 3]
    rows = spark.createDataFrame([("x", v) for v in values], "g string, v bigint")
    s = sorted(v for v in values if v is not None)
    got = evaluate.nearest_rank(rows, ["g"], "v", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}).first()
    assert [got[x] for x in "abcd"] == [s[round(p * 6)] for p in (0, 0.5, 0.9, 1)]


def test_confusion_and_recall(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True), (True, None)], "expected_approved boolean, approved boolean")
    c = evaluate.confusion(rows).first()
    assert (c["total"], c["approved_right"], c["denied_right"], c["approved_wrong"], c["denied_wrong"], c["errors"], c["accuracy"]) == (5, 1, 1, 1, 1, 1, 0.4)
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 5)], "q_id bigint, ref_id bigint")
    assert evaluate.recall(truth.filter("ref_id < 5"), truth).first()["recall"] == 0.75
    assert evaluate.recall(truth, truth.limit(0)).first()["recall"] is None


def test_deltas(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 1, 4)], "i string, t int, n bigint")
    got = {(r["i"], r["t"]): r["n_delta"] for r in evaluate.deltas(rows, ["i"], "t", ["n"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 4, ("b", 1): None}


def test_metrics_text(spark):
    counters = spark.createDataFrame([("requests", 7)], "name string, n bigint")
    summaries = spark.createDataFrame([("parse", 3, 10, 8, 16, 16, 16, 15)], "name string, n bigint, mean bigint, p50 bigint, p90 bigint, p99 bigint, p999 bigint, max bigint")
    buckets = spark.createDataFrame([("parse", 4, 2), ("parse", 3, 1)], "name string, bucket int, n bigint")
    lines = metrics_text.report(counters).union(metrics_text.summary_lines(summaries)).union(metrics_text.bucket_lines(buckets))
    texts = [r["value"] for r in lines.collect()]
    assert texts == ["requests 7", "hist_parse_ns count=3 mean=10 p50=8 p90=16 p99=16 p999=16 max=15", "buckets_parse_ns b3=1 b4=2"]
    got = {(r["kind"], r["name"], r["field"]): r["n"] for r in metrics_text.parse(lines).collect()}
    assert got["counter", "requests", None] == 7 and got["summary", "parse", "p999"] == 16 and got["bucket", "parse", "4"] == 2 and len(got) == 10


def test_reference_files(spark, tmp_path):
    import gzip

    records = [{"vector": [i / 100] * 14, "label": "fraud" if i % 2 else "legit"} for i in range(10)] + [{"vector": [1.0], "label": "fraud"}, {"label": "legit"}]
    plain, packed = tmp_path / "a.json", tmp_path / "b.json.gz"
    plain.write_text(json.dumps(records))
    packed.write_bytes(gzip.compress(json.dumps(records).encode()))
    for path in (plain, packed):
        rows = references.read_references(spark, str(path)).orderBy("ref_id").collect()
        assert [r["is_fraud"] for r in rows] == [bool(i % 2) for i in range(10)]
    assert references.count_records(spark.read.text(str(plain), wholetext=True)).first()["n"] == 12


def test_payload_files_and_corpus(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"id": "a", "x": {"y": [1, 2]}}, {"id": "b"}]))
    rows = payloads.read_payload_array(spark, str(tmp_path / "p.json")).orderBy("pos").collect()
    assert [json.loads(r["value"])["id"] for r in rows] == ["a", "b"]
    (tmp_path / "c.json").write_text(json.dumps({"references_checksum_sha256": "x", "stats": {}, "entries": [{"request": {"id": "a"}, "expected_approved": True, "expected_fraud_score": 0.2}]}))
    entry = payloads.read_corpus(spark, str(tmp_path / "c.json"))
    assert json.loads(entry.first()["value"]) == {"id": "a"} and entry.first()["expected_approved"]
    payloads.write_corpus(entry, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
