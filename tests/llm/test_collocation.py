"""Phrases against counting by hand, on small texts with a low bound."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vicinal.llm import collocation

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def by_hand(rows, longest, least, share, most):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    out = []
    for p, a in candidates.items():
        inside = lambda q: q[0] == p[0] and len(q) > len(p) and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q)))  # noqa: B023, E731
        if any(inside(q) and 100 * f >= share * a for q, f in candidates.items()):
            continue
        lang = p[0]
        cuts = [(1000 * a * n[lang] // (counts[p[: k + 1]] * counts[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.append((lang, " ".join(p[1:]), a, counts[p[: k + 1]], counts[(lang, *p[k + 1 :])], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place = Counter()
    ranked = []
    for r in out:
        place[r[0]] += 1
        if place[r[0]] <= most:
            ranked.append((r[0], place[r[0]], *r[1:]))
    return ranked


def found(spark, rows, **settings):
    df = collocation.collocations(spark.createDataFrame(rows, "lang string, text string"), **settings)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "cc", "été", "漢字", "d\x1ce", "x-y", "f", "the", "\x00", "h"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", ";", "\x0b"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), text + rng.choice(["", " new york city hall ", "new york city hall! New York city"])))
    return [*rows, ("en", None), ("en", ""), (None, " \t. "), ("en", "the the the the the the the"), ("fr", "ONE two")]


def test_phrases_are_those_counted_by_hand(spark):
    for seed, settings in ((1, {"longest": 5, "least": 6, "share": 100, "most": 2000}), (2, {"longest": 5, "least": 3, "share": 80, "most": 15}), (3, {"longest": 3, "least": 9, "share": 100, "most": 2000})):
        rows = texts(seed)
        want = by_hand(rows, *(settings[k] for k in ("longest", "least", "share", "most")))
        assert len(want) > 20
        assert found(spark, rows, **settings) == sorted(want)


def test_a_full_array_of_bits_changes_nothing(spark):
    rows = texts(4)
    assert found(spark, rows, least=4, bits=64) == sorted(by_hand(rows, 5, 4, 100, 2000))


def test_small_chunks_and_segments_change_nothing(spark, monkeypatch):
    rows = texts(5)
    want = sorted(by_hand(rows, 5, 4, 100, 2000))
    for name, value in (("UNIT", 300), ("CHUNK", 50), ("HELD", 1), ("HOT_SHARE", 20), ("PARTS", 3)):
        monkeypatch.setattr(collocation, name, value)
    assert found(spark, rows, least=4) == want


def test_stripes_have_totals_of_their_prefixes(spark):
    rows = texts(6)
    _, phrases, stripes = collocation.count_phrases(spark.createDataFrame(rows, "lang string, text string"), 4, 5)
    for n in range(1, len(stripes)):
        own = {(r["lang"], r["phrase"]): r["a"] for r in phrases[n - 1].collect()}
        totals = {(r["lang"], r["prefix"]): r["f"] for r in stripes[n].groupBy("lang", "prefix").agg(F.sum("total").alias("f")).collect()}
        assert {k: v for k, v in totals.items() if k in own} == own


def test_colliding_keys_are_kept_apart():
    columns = np.array([[1, 2, 1, 2, 1], [5, 5, 5, 6, 5]])
    order, first = collocation._groups(np.zeros(5, np.uint64), columns)
    groups = [sorted(order[a:b].tolist()) for a, b in zip(first, [*first[1:], 5], strict=True)]
    assert sorted(groups) == [[0, 2, 4], [1], [3]]


def test_hashes_of_tasks_and_tables_agree():
    chunk = collocation.Chunk("fr", [collocation.encoded([b"x. a"]), collocation.encoded(["l’été est là. été".encode()])])
    at = chunk.words.to_pylist().index("l’été".encode())
    assert int(chunk.phrase_hashes(3)[chunk.ids.tolist().index(at)]) == collocation.phrase_hash("fr", "l’été est là".encode())


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(4_000_000_000_000, 9_000_000_000_000_000, 5_000_000_000_000, 4_500_000_000_001)], "a bigint, n bigint, l bigint, r bigint")
    got = rows.selectExpr("(1000BD * cast(cast(a as decimal(16,0)) * cast(n as decimal(16,0)) as decimal(32,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0))) as s").first()["s"]
    assert got == 1000 * 4_000_000_000_000 * 9_000_000_000_000_000 // (5_000_000_000_000 * 4_500_000_000_001)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert found(spark, rows, least=2) == sorted(by_hand(rows, 5, 2, 100, 2000))
    assert collocation.collocations(odd_docs, least=2).count() == len(by_hand(rows, 5, 2, 100, 2000))
    assert collocation.collocations(no_docs).collect() == []
    assert collocation.collocations(odd_docs.filter("text is null")).collect() == []
