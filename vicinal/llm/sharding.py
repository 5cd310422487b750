"""Sharding by a hierarchical weighted hash tree.

A shard is found by descending region, rack and shard levels. At every level
each child draws ``-ln(u) / weight`` from a hash of the row's key and the
child's name, and the smallest draw wins. A child's weight is the sum of the
leaves below it, so a change of weights moves rows only at the nodes above the
leaves that changed. A shard that joins as a region of its own adds one draw
at the root: rows move into it and nowhere else.

Defined cases: a null key draws as one fixed key; rows that repeat a key share
its shard and take slots in an order given by a hash of all their columns but
maps; an empty table gives an empty result; other columns are carried along unless
they have the name of an output, which replaces them.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.llm.common import broadcast_if_small, chunk_count, hashed, written
from vicinal.session import table

#: A tree is a list of leaves: (region, rack, shard, weight).
Leaf = tuple[str, str, int, float]


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> list[Leaf]:
    """``shards`` leaves of weight 1 spread evenly over regions and racks."""
    return [(f"r{i % regions}", f"k{i // regions % racks}", i, 1.0) for i in range(shards)]


def grown_tree(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own."""
    number = max(leaf[2] for leaf in tree) + 1
    return [*tree, (f"grown{number}", "k0", number, weight)]


def _draw(key: Column, node: Column, weight: Column) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from a hash of key and node name."""
    u = (F.shiftrightunsigned(F.xxhash64(key, node), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(u) / weight


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard number that ``key`` descends to."""
    children: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    leaves = {}
    for region, rack, shard, weight in tree:
        if weight <= 0:
            raise ValueError("weights must be positive; leave a retired shard out of the tree")
        at = ""
        for part in (region, rack, str(shard)):
            children[at][f"{at}/{part}"] += weight
            at = f"{at}/{part}"
        leaves[at] = shard

    def step(node: str) -> Column:
        kids = sorted(children[node].items())
        if len(kids) == 1:
            return F.lit(leaves[kids[0][0]]) if kids[0][0] in leaves else step(kids[0][0])
        drawn = F.array_min(F.array(*[F.struct(_draw(key, F.lit(k), F.lit(w)).alias("d"), F.lit(i).alias("i")) for i, (k, w) in enumerate(kids)]))["i"]
        if kids[0][0] in leaves:
            return F.element_at(F.array(*[F.lit(leaves[k]) for k, _ in kids]), drawn + 1)
        out = F.when(drawn == 0, step(kids[0][0]))
        for i, (k, _) in enumerate(kids[1:], 1):
            out = out.when(drawn == i, step(k))
        return out

    return step("").cast("int")


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` (key, shard, hash, row: a struct) with ``slot``: a number without gaps, from 0, in each shard.

    A shard is cut into chunks by the hash of its rows, so that many tasks
    number one shard: about as many chunks as rows in one, whatever the number
    of partitions, so reruns agree. The chunks' first slots come from a table of
    (shard, chunk) counts.
    """
    chunks = chunk_count(rows)
    rows = rows.withColumn("chunk", F.pmod("hash", F.lit(chunks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("key", "hash"))
    numbered = rows.withColumn("within", within).join(broadcast_if_small(written(first, "slots")), ["shard", "chunk"])
    return numbered.withColumn("slot", (F.col("first") + F.col("within") - 1).cast("long")).drop("chunk", "within", "first")


def shard_documents(docs: DataFrame, tree: list[Leaf], key: str = "doc_id") -> DataFrame:
    """``docs`` with the columns shard, slot and grown_shard (the shard with one more leaf)."""
    carried = [c for c in docs.columns if c not in ("shard", "grown_shard", "slot")]
    # The row travels as one struct, so its names cannot clash with those used here.
    rows = docs.select(F.col(key).alias("key"), hashed(docs).alias("hash"), F.struct(*carried).alias("row"))
    rows = rows.withColumn("shard", shard_of(F.col("key"), tree)).withColumn("grown_shard", shard_of(F.col("key"), grown_tree(tree)))
    return with_slots(rows).select("row.*", "shard", "slot", "grown_shard")


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``key``: doc_id and the number of shards decide."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard_documents(docs, even_tree(16)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op8_hash_tree_sharding": op8_hash_tree_sharding}
ORACLE_SQL: dict[str, str] = {}
