import math
import re
from collections import defaultdict

import numpy as np
import pytest
from test_sharding import chained

from vicinal.llm import mixing


def filled(sizes, weights, share=1.5, cap=2.0):
    """Targets by the definition: what is above the cap goes to the others, until none is above."""
    out, left, free = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), {s for s in sizes if sizes[s]}
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > cap * sizes[s]}
        out |= {s: left * weights[s] / total for s in free}
        if not over:
            break
        out |= {s: cap * float(sizes[s]) for s in over}
        left, free = left - sum(cap * sizes[s] for s in over), free - over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 10, "d": 0, None: 500}, {"a": 0}, {}, {"x": 7}, {f"s{i}": i * i for i in range(40)}])
def test_targets_fill_up_to_the_cap(spark, sizes):
    docs = spark.createDataFrame([(1, s, n) for s, n in sizes.items()], "doc_id bigint, source string, size bigint")
    named = mixing.sources(docs)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    assert {r["source"]: (r["words"], r["weight"]) for r in named.collect()} == {s: (sizes[s], weights[s]) for s in sizes}
    got = {r["source"]: r["target"] for r in mixing.plan(named, mixing.fill_level(named)).collect()}
    assert got == {s: pytest.approx(t) for s, t in filled(sizes, weights).items()}


def test_splitting_tree_keeps_quotas():
    for blocks, quota, shards in ((1000, 300, 7), (3, 3, 5), (10, 0, 4), (100_000, 99_999, 16)):
        pools, drawn = mixing.split_tree(blocks, quota, shards, np.random.default_rng(1))
        assert sum(pools) == blocks and sum(drawn) == quota and len(pools) == shards
        assert all(0 <= d <= p for d, p in zip(drawn, pools, strict=True)) and max(pools) - min(pools) <= 3
    # Each shard's quota has the mean and variance of a multivariate hypergeometric draw.
    many = np.array([mixing.split_tree(1000, 300, 4, np.random.default_rng(i))[1] for i in range(2000)])
    assert np.abs(many.mean(axis=0) - 75).max() < 1
    assert np.abs(many.var(axis=0) / (300 * 0.25 * 0.75 * 700 / 999) - 1).max() < 0.15


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096])
def test_places_are_a_permutation(spark, n):
    F = mixing.F
    rows = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(99).cast("bigint")).alias("place")).collect()
    assert sorted(r["place"] for r in rows) == list(range(n))
    assert n < 10 or sum(r["id"] == r["place"] for r in rows) < 8


@pytest.fixture(scope="module")
def mixed(spark, sf_docs):
    docs = sf_docs.select("doc_id", "source", mixing.word_count(mixing.F.col("text")).alias("size"))
    return mixing.mix(docs).collect()


def test_sources_come_near_their_targets(mixed):
    words, taken = defaultdict(int), defaultdict(int)
    for r in mixed:
        own = sum(p["end"] - p["first"] for p in r["pieces"])
        assert own <= 2 * r["size"]
        words[r["source"]] += r["size"]
        taken[r["source"]] += own
    for r in mixed:
        assert r["source_size"] == words[r["source"]]
        assert abs(taken[r["source"]] - r["target"]) <= max(2, 0.01 * r["target"])


def test_pieces_of_a_pass_are_disjoint_and_whole(mixed):
    for r in mixed:
        by = defaultdict(list)
        for p in r["pieces"]:
            assert 0 <= p["first"] < p["end"] <= r["size"] and 0 <= p["shard"] < 16
            by[p["pass"]].append((p["first"], p["end"]))
        for spans in by.values():
            spans.sort()
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_reruns_agree_whatever_the_partitions(spark, sf_docs, mixed):
    docs = sf_docs.select("doc_id", "source", mixing.word_count(mixing.F.col("text")).alias("size"))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("2", "13", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(mixing.mix(docs.repartition(7)).collect()) == sorted(mixing.mix(docs).collect()) == sorted(mixed)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def mirrored(x, blocks, key):
    """A block's place, by the definition of the network."""
    signed = lambda v: v - 2**64 * (v >= 2**63)
    for turn in range(1, mixing.ROUNDS + 1):
        point = signed(chained(key, [turn]))
        mirror = (int(math.fmod(point, blocks)) if abs(point) < 2**50 else abs(point) % blocks * (1 if point >= 0 else -1)) - x
        mirror %= blocks
        if chained(max(x, mirror), [turn], key) & 1:
            x = mirror
    return x


def test_query_against_brute_force(spark):
    """Every row of op10, from sizes, ids and the seed alone; and the tree decides it."""
    docs = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    signed = lambda v: v - 2**64 * (v >= 2**63)
    order = sorted({d[1] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, x, n in docs if x == s) for s in order}
    goal, chunks, want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}), math.isqrt(len(docs)), {}
    for s in order:
        key, words = signed(chained(s, [0], [mixing.SEED])) if s else None, sizes[s]
        block = max(1, min(mixing.BLOCK_WORDS, words // mixing.LEAST_BLOCKS))
        blocks, whole = -(-words // block), min(int(goal[s] // words), 2)
        rest = max(0, min(words, round(goal[s]) - whole * words))
        quota = -(-rest // block)
        pools, drawn = mixing.split_tree(blocks, quota, 16, np.random.default_rng([mixing.SEED, key % 2**64]))
        first, last = np.cumsum([0, *pools]), max((i for i, n in enumerate(drawn) if n), default=None)
        at = lambda d: signed(chained(d, [mixing.SEED]))
        start = 0
        for doc, _, size in sorted((d for d in docs if d[1] == s), key=lambda d: (at(d[0]) % chunks, at(d[0]), d[0])):
            taken, dealt = 0, []
            for b in range(start // block, -(-(start + size) // block)):
                place = mirrored(b, blocks, key)
                pool = int(np.searchsorted(first, place, side="right")) - 1
                rank = place - first[pool]
                for turn in range(whole + 1):
                    room = block if turn < whole else 0 if rank >= drawn[pool] else rest - (quota - 1) * block if (pool, rank) == (last, drawn[pool] - 1) else block
                    n = min(start + size, b * block + room) - max(start, b * block)
                    if n > 0:
                        taken, dealt = taken + n, [*dealt, ((pool + turn) % 16, turn, max(start, b * block) - start, n)]
            want[doc] = (size, words, pytest.approx(goal[s]), taken, ",".join(f"{x[0]}:{x[3]}" for x in sorted(dealt)))
            start += size
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"], r["dealt"]) for r in mixing.op10_splitting_tree_mix(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_the_tree_decides_what_is_taken(spark, monkeypatch):
    """With another split of the quotas other documents are taken, and other documents stay in the pipeline."""
    F, path = mixing.F, "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{path}/documents.parquet")
    taken = lambda: {r["doc_id"]: r["taken"] for r in mixing.op10_splitting_tree_mix(spark, path).collect()}
    copies = lambda: sorted(r["doc_id"] for r in mixing.mixed_documents(texts).collect())
    before = taken(), copies()

    def in_order(blocks, quota, shards, rng):
        pools = [blocks * (i + 1) // shards - blocks * i // shards for i in range(shards)]
        drawn = []
        for pool in pools:
            drawn.append(min(pool, quota - sum(drawn)))
        return pools, drawn

    monkeypatch.setattr(mixing, "split_tree", in_order)
    after = taken(), copies()
    assert before[0] != after[0] and before[1] != after[1]
    total = texts.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(sum(before[0].values()) - 1.5 * total) < 0.02 * total


def test_columns_with_names_of_the_plan(spark, sf_docs):
    F = mixing.F
    names = ("block", "blocks", "rest", "runs", "shift", "whole", "factor", "target", "pieces", "start", "source_size", "key", "pools", "drawn", "tie", "quota", "place", "_row", "_plan", "_at")
    odd = sf_docs.select("doc_id", "source", "text", mixing.word_count(F.col("text")).alias("size"), F.create_map(F.lit(1), F.lit(2)).alias("m"), *[F.lit("x").alias(n) for n in names])
    rows = mixing.mix(odd)
    assert rows.count() == sf_docs.count() and {r["rest"] for r in rows.select("rest").collect()} == {"x"}
    whole = mixing.mixed_documents(odd)
    assert whole.columns == odd.columns and {tuple(r[n] for n in names) for r in whole.collect()} == {("x",) * len(names)}


def test_shards_get_their_quotas_and_random_order(spark, sf_docs):
    docs = sf_docs.select("doc_id", "source", mixing.word_count(mixing.F.col("text")).alias("size"))
    rows = mixing.shuffled_pieces(mixing.mix(docs, shards=4)).collect()
    words = defaultdict(int)
    for r in rows:
        words[r["shard"]] += r["end"] - r["first"]
    assert max(words.values()) < 1.2 * min(words.values())
    assert [r["doc_id"] for r in rows] != sorted(r["doc_id"] for r in rows)


def test_word_count(spark, odd_docs):
    texts = ["", " ", "a", "a b", " a\t\nb\x0b\x0cc\rd ", "a b c", "é x", None, "x" * 9]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", mixing.word_count(mixing.F.col("text")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("size", mixing.word_count(mixing.F.col("text")))
    rows = mixing.mix(docs).collect()
    assert len(rows) == odd_docs.count() and all(sum(p["end"] - p["first"] for p in r["pieces"]) <= 2 * r["size"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    whole = mixing.mixed_documents(odd_docs)
    assert whole.columns == odd_docs.columns and {r["size"] for r in whole.collect()} == {"x"}
    assert mixing.mixed_documents(no_docs).count() == 0


def test_repeated_rows_are_picked_one_by_one(spark):
    """Rows that are the same in all columns come as often as their pieces say, in all."""
    F = mixing.F
    rows = [(i % 40, f"word {i % 40} and so on " * (i % 7 + 1), f"s{i % 3}") for i in range(120)] + [(None, "no id at all", "s1")] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text"))))
    middle = F.floor(F.col("size") / 2)
    want = {(r["doc_id"], r["text"]): r["n"] for r in mixed.groupBy("doc_id", "text").agg(F.sum(F.size(F.filter("pieces", lambda p: (p["first"] <= middle) & (p["end"] > middle)))).alias("n")).collect()}
    got = {(r["doc_id"], r["text"]): r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id", "text").count().collect()}
    assert got == {k: n for k, n in want.items() if n}
