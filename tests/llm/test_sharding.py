import math
import struct
from collections import Counter

import pytest
import xxhash

from vicinal.llm import sharding


def placed(spark, tree, n=4000):
    rows = spark.range(n).select("id", sharding.shard_of(sharding.F.col("id"), tree).alias("s")).collect()
    return {r["id"]: r["s"] for r in rows}


def test_growth_moves_rows_into_the_new_shard_only(spark):
    tree = sharding.even_tree(16)
    before, after = placed(spark, tree), placed(spark, sharding.grown_tree(tree))
    moved = {k for k in before if before[k] != after[k]}
    assert {after[k] for k in moved} == {16} and 0.6 < len(moved) / (4000 / 17) < 1.5
    counts = Counter(before.values())
    assert set(counts) == set(range(16)) and max(counts.values()) < 1.5 * min(counts.values())


def test_changes_stay_in_their_subtree_and_above(spark):
    """A heavier leaf draws rows; between the other leaves of other subtrees none move."""
    tree = sharding.even_tree(16)
    heavier = [(r, k, s, 3.0 if s == 5 else w) for r, k, s, w in tree]
    rack = {s: (r, k) for r, k, s, _ in tree}
    before, after = placed(spark, tree), placed(spark, heavier)
    for key in before:
        if before[key] != after[key]:
            # A row moves inside the changed rack or region, or into the changed region.
            assert rack[after[key]][0] == rack[5][0]
    assert Counter(after.values())[5] > 2 * Counter(before.values())[5]


def test_weights_are_shares(spark):
    tree = [("a", "x", 0, 1.0), ("a", "y", 1, 2.0), ("b", "z", 2, 5.0)]
    counts = Counter(placed(spark, tree).values())
    for s, w in ((0, 1), (1, 2), (2, 5)):
        assert abs(counts[s] / 4000 - w / 8) < 0.03


def test_slots_have_no_gaps(spark, odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, sharding.even_tree(4)).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 9}) == 1
    assert set(odd_docs.columns) <= set(rows[0].asDict()) and {r["size"] for r in rows} == {"x"}
    assert sharding.shard_documents(no_docs, sharding.even_tree(4)).count() == 0


def test_query_digests(spark):
    import zlib

    rows = sharding.op8_hash_tree_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(k, len(t) + 1, zlib.crc32(t)) for k, t in texts.items()}
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)


def chained(*values):
    """Spark's xxhash64 of longs, ints in a list of one, and strings; unsigned."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, list) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def descend(key, tree):
    """A shard by the definition: at each level the child with the smallest -ln(u) / weight."""
    at, part = "", tree
    for level in range(3):
        children = {}
        for leaf in part:
            children.setdefault(f"{at}/{leaf[level]}", []).append(leaf)
        draw = lambda k: -math.log(((chained(key, k) >> 11) + 0.5) * 2.0**-53) / sum(x[3] for x in children[k])  # noqa: E731, B023
        at = min(sorted(children), key=draw)
        part = children[at]
    return part[0][2]


@pytest.mark.parametrize("parts", ["2", "13"])
def test_query_against_recomputed_draws(spark, parts):
    """Shards from the draws, slots from the order of chunk, key and hash, whatever the number of partitions."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = sharding.op8_hash_tree_sharding(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    tree, chunks, by = sharding.even_tree(16), math.isqrt(len(rows)), {}
    for r in rows:
        assert r["shard"] == descend(r["doc_id"], tree) and r["grown_shard"] == descend(r["doc_id"], sharding.grown_tree(tree))
        key = chained(r["doc_id"], r["size"], r["text_crc32"])
        key -= 2**64 * (key >= 2**63)
        by.setdefault(r["shard"], []).append((key % chunks, r["doc_id"], key, r["slot"]))
    assert all([x[3] for x in sorted(own)] == list(range(len(own))) for own in by.values())
