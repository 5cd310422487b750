import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vicinal.llm import language


def grams(texts):
    out = Counter()
    for t in texts:
        out.update(language.gram_codes(language.normal(t)).tolist())
    return dict(out)


def slow_bits(tree, size, data):
    """The code length by walking the tree, byte by byte."""
    data, total = b"  " + data, 0.0
    for at in range(3, len(data)):
        for order in (3, 2, 1, 0):
            seen = tree[order].get(tuple(data[at - order : at]))
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[at] in seen:
                total += math.log2((n + d) / seen[data[at]])
                break
            total += math.log2((n + d) / d)
        else:
            total += math.log2(size)
    return total


def test_tables_give_the_exact_code_lengths():
    rng = random.Random(3)
    texts = {x: ["".join(rng.choices(a, k=400)) for _ in range(4)] for x, a in (("l1", "abc d"), ("l2", "abe é"))}
    own = {x: grams(t) for x, t in texts.items()}
    model = language.Model(own)
    trees = {x: language.Model._tree(g) for x, g in own.items()}
    for text in ["abc", "abe é cd", "zzz abc", "ééé", "d c b a e"]:
        data = language.normal(text)
        want = [slow_bits(trees[x], model.size, data) for x in model.langs]
        assert model.code_lengths(data) == pytest.approx(want, rel=1e-5)


def test_probabilities_sum_to_at_most_one():
    model = language.Model({"x": grams(["abracadabra " * 9])})
    for before in (b"abr", b"rac", b"zzz", b"  a", b"zab"):
        each = [model.groups[0].bits(np.array([int.from_bytes(before + bytes([s]))], np.uint32))[0] for s in set(b"abrcd z")]
        assert sum(2.0 ** -b for b in each) <= 1 + 1e-5


def test_keys_are_found():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**32, n, dtype=np.uint32))
        index, place = language.Keys(keys), rng.permutation(len(keys))
        assert (index.find(keys[place]) == place).all()
        other = np.setdiff1d(rng.integers(0, 2**32, 1000, dtype=np.uint32), keys)
        assert (index.find(other) == -1).all()


def test_many_languages_leave_nothing_out():
    """Groups of languages give the exact lengths that all of them together give."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñçøłşğ"
    own = {f"l{i:02}": grams(["".join(rng.choices(letters[i % 20 : i % 20 + 15] + "  ", k=600))]) for i in range(37)}
    model = language.Model(own)
    assert len(model.groups) == 3
    for text in ("abc def ghi", "éèñ ñç zø", "qrstu vwx"):
        data = language.normal(text)
        want = [slow_bits(language.Model._tree(own[x]), model.size, data) for x in model.langs]
        assert model.code_lengths(data) == pytest.approx(want, rel=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in own) / len(own) > 0.97


def test_labels_of_held_out_rows_and_sources_do_not_matter(spark, sf_docs):
    from pyspark.sql import functions as F

    other = sf_docs.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(language.identify(other).collect()) == sorted(language.identify(sf_docs).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    got = {}
    for r in language.identify(odd_docs).collect():
        got.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert got[1] == got[2] == got[7] == got[8] == ["und"] and len(got[9]) == 2 and got[10] != ["und"]
    assert language.identify(no_docs).count() == 0
    nothing = odd_docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(nothing).collect()} == {("und", 0.0)}
    kept = language.accepted(odd_docs, language.fit(odd_docs))
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 3, 4, 5, 6, 9, 10}


def test_noise_is_rejected(spark, sf_docs):
    rng = random.Random(4)
    noise = "".join(rng.choices("qxzjkvwpßæœłøđ", k=400))
    docs = spark.createDataFrame([(10**9, noise)], "doc_id bigint, text string")
    model = language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    lang, _, bits = model.predict(noise)
    assert bits > model.noise[lang] >= np.log2(model.size)
    assert language.accepted(docs, model).count() == 0 and language.accepted(sf_docs, model).count() == sf_docs.count()
