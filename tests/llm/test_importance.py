"""Weights, scores and draws against the formulas, one row at a time."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vicinal.llm import importance
from vicinal.llm.common import written


def features(text, longest=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def by_hand(docs, target, per_cent=10, least=20, buckets=10_000, longest=1, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for doc_id, text in docs:
        n, found = features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    for i, r in enumerate(able[: per_cent * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def drawn(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["The", "of", "Ünïcode", "漢字", "a1", "b-c", "x_y", "Zeta", "mu", "q"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize(("longest", "per_cent", "least"), [(1, 10, 20), (2, 35, 5), (1, 100, 0), (3, 0, 20)])
def test_as_by_hand(spark, longest, per_cent, least):
    docs, target = texts(400, 1), [t for _, t in texts(30, 2)]
    df = importance.resample(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), spark.createDataFrame([(t,) for t in target], "text string"), per_cent, least, buckets=97, longest=longest)
    assert drawn(df) == by_hand(docs, target, per_cent, least, 97, longest)


def test_ties_and_repeated_rows_are_cut_exactly(spark):
    docs = [(5, "same words " * 15)] * 60 + [(i, "same words " * 15) for i in range(40)]
    df = importance.resample(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame([("other",)], "text string"), per_cent=45)
    got = [r for r in df.collect() if r["rank"] is not None]
    assert sorted(r["rank"] for r in got) == list(range(1, 46))
    assert drawn(df) == by_hand(docs, ["other"], per_cent=45)


def test_kth_key_is_that_of_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 300), i) for i in range(5000)]
    df = written(spark.createDataFrame(rows, "v bigint, tie bigint").select(F.struct("v", "tie").alias("key"), "tie"), "keys")
    keys = sorted(rows)
    for k in (1, 2, 777, 2500, 4999, 5000):
        for pivots in (1, 7, 32):
            if pivots > 1 or k in (1, 777):
                assert tuple(importance.kth_key(df, k, pivots=pivots)) == keys[k - 1]
    assert importance.kth_key(df, 5001) is None


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    target = spark.createDataFrame([(None,), ("the same words",)], "text string")
    df = importance.resample(odd_docs, target, per_cent=50, least_words=1)
    assert "size" in df.columns and df.columns.count("score") == 1 and "text" not in df.columns
    assert drawn(df) == by_hand(rows, [None, "the same words"], 50, 1)
    assert "text" in importance.resample(odd_docs, target, carry=["text"]).columns
    empty = target.limit(0)
    assert drawn(importance.resample(odd_docs, empty)) == by_hand(rows, [])
    assert importance.resample(no_docs, target).count() == 0
