import json

import pytest
from pyspark.sql import functions as F

from vicinal.operators import features

G0 = {
    "id": "a", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["M3", "M16"]}, "merchant": {"id": "M16", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.2331036248}, "last_transaction": None,
}
G1 = {
    "id": "b", "transaction": {"amount": 384.88, "installments": 3, "requested_at": "2026-03-11T20:23:35Z"},
    "customer": {"avg_amount": 769.76, "tx_count_24h": 3, "known_merchants": ["M1"]}, "merchant": {"id": "M1", "mcc": "5912", "avg_amount": 298.95},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 13.7090520965}, "last_transaction": {"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.8626479774},
}
G2 = {
    "id": "c", "transaction": {"amount": 99999, "installments": 30, "requested_at": "2026-02-31T00:00:00Z"},
    "customer": {"avg_amount": 0, "tx_count_24h": 99, "known_merchants": []}, "merchant": {"id": "M1", "mcc": "1234", "avg_amount": 0},
    "terminal": {"is_online": True, "card_present": False, "km_from_home": -5}, "last_transaction": {"timestamp": "2026-02-28T00:00:59Z", "km_from_current": 5000},
}
GOLDEN = [
    (G0, [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006], 1e-3),
    (G1, [384.88 / 10000, 3 / 12, 0.05, 20 / 23, 2 / 6, 325 / 1440, 18.8626479774 / 1000, 13.7090520965 / 1000, 3 / 20, 0, 1, 0, 0.20, 298.95 / 10000], 1e-5),
    (G2, [1, 1, 0, 0, 1 / 6, 1, 1, 0, 1, 1, 0, 1, 0.5, 0], 1e-6),
]


def changed(**paths):
    out = json.loads(json.dumps(G1))
    for path, value in paths.items():
        at, _, last = path.rpartition("__")
        (out[at] if at else out)[last] = value
    return json.dumps(out)


def run(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    return features.vectorize(rows).orderBy("i").collect()


def test_golden_vectors(spark):
    got = run(spark, [json.dumps(g[0]) for g in GOLDEN])
    for row, (_, want, tolerance) in zip(got, GOLDEN, strict=True):
        assert row["reason"] is None
        assert row["features"] == pytest.approx(want, abs=tolerance)


def test_reasons(spark):
    cases = {
        "{}": "missing_field", "[1]": "malformed", '{"id":': "malformed", "": "malformed", None: "malformed",
        changed(merchant__mcc="541"): "invalid_mcc", changed(merchant__mcc="54a1"): "invalid_mcc", changed(merchant__mcc="0000"): None, changed(merchant__mcc="9999"): None,
        changed(transaction__installments=4294967295): None, changed(transaction__installments=4294967296): "invalid_number", changed(transaction__installments=-1): "invalid_number",
        changed(transaction__requested_at="2026-03-11T24:00:00Z"): "invalid_date", changed(transaction__requested_at="2026-13-11T20:00:00Z"): "invalid_date",
        changed(transaction__requested_at="2026-03-32T20:00:00Z"): "invalid_date", changed(transaction__requested_at="soon"): "invalid_date",
        changed(transaction__amount=-5): None, changed(last_transaction={"timestamp": "x", "km_from_current": 1}): "invalid_last_transaction", changed(last_transaction=None): None,
    }
    for (text, want), row in zip(cases.items(), run(spark, list(cases)), strict=True):
        assert row["reason"] == want, text
        assert (row["features"] is None) == (want is not None)


def test_minutes_cross_midnight_and_count_absolutely(spark):
    texts = [changed(transaction__requested_at="2026-03-12T01:00:00Z", last_transaction={"timestamp": f"2026-03-{d}T{h}:00:00Z", "km_from_current": 0}) for d, h in (("11", "23"), ("12", "03"))]
    assert [round(r["features"][5] * 1440) for r in run(spark, texts)] == [120, 120]


def test_values_stay_in_range(spark):
    for row in run(spark, [json.dumps(g[0]) for g in GOLDEN]):
        assert all(0 <= x <= 1 or (x == -1 and i in (5, 6)) for i, x in enumerate(row["features"]))


def test_one_pass_without_shuffle(spark):
    rows = spark.range(10).select(F.lit(json.dumps(G0)).alias("value"))
    plan = features.vectorize(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Python" not in plan


def test_texts_are_parsed_once(spark):
    """However many features are used, the optimized plan holds one from_json."""
    from vicinal.plans import table_queries

    for name in ("payload_vectorize_14", "payload_validation"):
        df = table_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1, name


def test_strict_mode(spark):
    """The golden payload as a rigid parser takes it, and texts that only the relaxed mode takes."""
    text = json.dumps(G1)
    relaxed_only = [
        text.replace('"amount": 384.88', '"amount": 3.8488e2'), text.replace('"id": "M1"', '"id": "M\\u0031"'), json.dumps(dict(reversed(G1.items()))),
        json.dumps({k: v for k, v in G1.items() if k != "last_transaction"}), json.dumps(G1 | {"more": 1}),
    ]
    both = [text, json.dumps(G0), json.dumps(G1, indent=3), text + " trailing", text.replace('"id": "b"', '"name": "b"').replace('"name": "b"', '"id": "b"')]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*both, *relaxed_only])], "i int, value string")
    strict = [r["reason"] for r in features.vectorize(rows, strict=True).orderBy("i").collect()]
    assert strict == [None] * len(both) + ["not_strict"] * len(relaxed_only)
    assert {r["reason"] for r in features.vectorize(rows).collect()} == {None}
