"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source form one stream: its documents in an order given by a
hash of the seed and the id. The stream is cut into blocks of equal length, so
a quota of words is an exact quota of blocks (the last one in part). A target
of e whole passes and a remainder takes every block e times and, once more,
as many blocks as the remainder asks for.

Which blocks those are is decided by a splitting tree over the output shards.
A drawn permutation of a source's blocks deals them to the shards' pools, and
every node of the tree splits its quota of the source between its children by
a hypergeometric draw from their pools; so a source's quotas by shard are one
multivariate hypergeometric draw, and their sum is the exact quota. A shard
takes the first of its pool, in the permuted order, up to its quota: blocks of
different shards are disjoint. Whole passes go round the shards, so that copies
of a block lie in different ones. Inside a shard, pieces are ordered by a hash,
which Spark sorts by shard.

The permutation is a swap-or-not network (Hoang, Morris, Rogaway 2012): each
block's place is computed from its number alone, so no list of blocks is made.

Sources may be as many as there are rows: their sizes, targets and quotas are
a table, never collected. The level to which targets are filled up takes a few
rounds, each of which brings two numbers a weight to the driver.

Defined cases: a null text has no words; a null source is a source of its own,
last in order; an empty source has target 0; rows that repeat an id are placed
one after the other in the stream, in the order of their sizes and of a hash of
their other columns (maps left out); other columns are carried along, unless
they have the name of an output, which replaces them. Reruns agree: everything
follows from the seed, the ids, the sizes and their number, and not from how
many partitions there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.llm.common import broadcast_if_small, chunk_count, hashed, written
from vicinal.session import table

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20240607
SHARDS = 16
WEIGHTS = (3, 1, 2)
#: A source's stream is cut into at least about so many blocks, of at most BLOCK_WORDS words...
LEAST_BLOCKS, BLOCK_WORDS = 256, 2048
#: ...and into so many at most, which the hypergeometric sampler takes; beyond 2**40 words a source, blocks grow.
MOST_BLOCKS = 2**29
#: Rounds of the swap-or-not network.
ROUNDS = 24
#: Plans of up to so many sources are broadcast (about 400 bytes each).
BROADCAST_SOURCES = 50_000
#: Rows that are ordered together inside a shard: small enough for whole texts; Spark joins small parts into partitions.
LOCAL_ROWS = 2_000


def word_count(text: Column) -> Column:
    """The number of words; a null text has none. Runs of white space are squeezed, so no list of words is built."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marked, " \t\n\x0b\f\r", "")).cast("long")


def sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, words, turn, weight of each source of ``docs`` (source, size), as a written table.

    Weights go in turn over the sources by code point, null last. Ranges of
    names are numbered apart, after the sources of all ranges before.
    """
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"))
    ranged = written(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    placed = ranged.withColumn("inside", inside).join(broadcast_if_small(written(starts, "starts")), "range")
    turn = F.pmod(F.col("start") + F.col("inside") - 1, F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    return written(placed.select("source", "words", turn.alias("turn"), weight.alias("weight")), "sources")


def over_the_cap(level: float, cap: float) -> Column:
    """Whether a source's share of the level is more than it may give."""
    return F.lit(level) * F.col("weight") > F.lit(cap) * F.col("words")


def fill_level(named: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> float:
    """Words a unit of weight at which the targets add up to ``share`` of all words, none above ``cap`` times its source.

    A source over its cap leaves its excess to the others, which raises the
    level; it settles when no more sources are over.
    """
    level = 0.0
    while True:
        over = over_the_cap(level, cap)
        found = named.filter("words > 0").groupBy("turn").agg(F.count_if(~over).alias("free"), F.sum("words").alias("words"), F.coalesce(F.sum(F.when(over, F.col("words"))), F.lit(0)).alias("capped")).collect()
        total = sum(weights[r["turn"]] * r["free"] for r in sorted(found, key=lambda r: r["turn"]))
        if not total:
            return float("inf")
        after = (share * sum(r["words"] for r in found) - cap * sum(r["capped"] for r in found)) / total
        if after <= level:
            return level
        level = after


def split_tree(blocks: int, quota: int, shards: int, rng: np.random.Generator) -> tuple[list[int], list[int]]:
    """Blocks in each shard's pool, and how many of them are drawn: ``quota`` of all ``blocks`` without putting back.

    A node cuts its pool between its children and draws how much of its quota falls to the first.
    """
    if shards == 1:
        return [blocks], [quota]
    left = shards // 2
    pool = blocks * left // shards
    drawn = int(rng.hypergeometric(pool, blocks - pool, quota)) if quota else 0
    first, second = split_tree(pool, drawn, left, rng), split_tree(blocks - pool, quota - drawn, shards - left, rng)
    return first[0] + second[0], first[1] + second[1]


def plan(named: DataFrame, level: float, shards: int = SHARDS, seed: int = SEED, cap: float = 2.0) -> DataFrame:
    """source, source_size, target, the blocks, the shards' pools (their first places) and quotas of each source, as a written table."""
    words = F.col("words")
    target = F.when(words == 0, 0.0).when(over_the_cap(level, cap), F.lit(cap) * words).otherwise(F.lit(min(level, 1e300)) * F.col("weight"))
    rows = named.select("source", words.alias("source_size"), target.alias("target"), F.xxhash64("source", F.col("source").isNull(), F.lit(seed)).alias("key"))
    size = F.col("source_size")
    rows = rows.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(size / LEAST_BLOCKS)), F.ceil(size / MOST_BLOCKS)).cast("bigint"))
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), F.expr("(source_size + block - 1) div block")))
    rows = rows.withColumn("whole", F.when(size == 0, 0).otherwise(F.least(F.floor(F.col("target") / F.greatest(size, F.lit(1))), F.lit(int(cap)))).cast("int"))
    rows = rows.withColumn("rest", F.greatest(F.lit(0), F.least(size, F.round("target").cast("bigint") - F.col("whole") * size)))
    rows = rows.withColumn("quota", F.expr("(rest + block - 1) div block"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            pools, quotas = [], []
            for key, blocks, quota in zip(*(batch.column(c).to_pylist() for c in ("key", "blocks", "quota")), strict=True):
                pool, drawn = split_tree(blocks, quota, shards, np.random.default_rng([seed, key % 2**64]))
                pools.append([0, *np.cumsum(pool).tolist()])
                quotas.append(drawn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pools, kind), pa.array(quotas, kind)], names=[*batch.schema.names, "pools", "drawn"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return written(rows.mapInArrow(draw, f"{schema}, pools array<bigint>, drawn array<bigint>"), "plan")


def with_starts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Each document's first word in its source's stream, as ``start`` (columns source, doc_id, size, tie; others are carried along).

    A prefix sum in two levels: inside chunks of a source, which a hash of the
    id spreads over all tasks, and over the chunks' totals, of which there is
    one for each source and chunk and which are joined back. There are about as
    many chunks as rows in a chunk.
    """
    chunks = chunk_count(docs)
    docs = docs.withColumn("_at", F.xxhash64("doc_id", F.lit(seed))).withColumn("_chunk", F.pmod("_at", F.lit(chunks)).cast("int"))
    docs = docs.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    totals = docs.groupBy("_source", "_chunk").agg(F.sum("size").alias("_words"))
    before = F.sum("_words").over(Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_source", "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_chunk").orderBy("_at", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return docs.join(broadcast_if_small(written(totals, "totals")), ["_source", "_chunk"]).withColumn("start", F.col("_before") + F.col("_inside")).drop("_at", "_chunk", "_source", "_before", "_inside")


def permuted(block: Column, blocks: Column, key: Column) -> Column:
    """The block's place in its source's permutation of 0 .. blocks - 1.

    In each round a block may change places with its mirror image about a
    random point; a hash of the pair decides whether both do.
    """

    def swap(x: Column, turn: Column) -> Column:
        mirror = F.pmod(F.xxhash64(key, turn) % blocks - x, blocks)
        swapped = F.xxhash64(F.greatest(x, mirror), turn, key).bitwiseAND(F.lit(1).cast("bigint")) == 1
        return F.when(swapped, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), block, swap)


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` (doc_id, source, size, ...) with source_size, target, start and ``pieces``.

    ``pieces`` lists what the shards take of the document: structs of the
    shard, the pass, and the first and end word in the document.
    """
    named = sources(docs, weights)
    plans = plan(named, fill_level(named, weights, share, cap), shards, seed, cap)
    plans = broadcast_if_small(plans.select(F.col("source").alias("_name"), F.struct(*[c for c in plans.columns if c != "source"]).alias("_plan")), BROADCAST_SOURCES)
    carried = [c for c in docs.columns if c not in ("source_size", "target", "start", "pieces")]
    # The row travels as one struct, so its names cannot clash with those used here.
    rows = docs.select("doc_id", "source", "size", hashed(docs).alias("tie"), F.struct(*carried).alias("_row"))
    rows = with_starts(rows, seed).join(plans, F.col("source").eqNullSafe(F.col("_name")))
    p = lambda name: F.col(f"_plan.{name}")
    first, last = F.expr("start div _plan.block"), F.expr("(start + size - 1) div _plan.block")
    spots = F.transform(F.sequence(first, last), lambda b: F.struct(b.alias("block"), permuted(b, p("blocks"), p("key")).alias("place")))
    spots = F.transform(spots, lambda s: F.struct(s["block"].alias("block"), s["place"].alias("place"), (F.size(F.filter(p("pools"), lambda upto: upto <= s["place"])) - 1).alias("pool")))
    last_pool = F.array_max(F.transform(p("drawn"), lambda n, i: F.when(n > 0, i)))

    def pieces_of(s: Column) -> Column:
        """What is taken of the document's words in a block, pass by pass."""
        rank, quota = s["place"] - F.get(p("pools"), s["pool"]), F.get(p("drawn"), s["pool"])
        # Of the quotas' last block only what is left of the remainder is taken.
        cut = F.when((s["pool"] == F.col("_last_pool")) & (rank == quota - 1), p("rest") - (p("quota") - 1) * p("block")).otherwise(p("block"))

        def piece(turn: Column) -> Column:
            room = F.when(turn < p("whole"), p("block")).when(rank < quota, cut).otherwise(F.lit(0))
            begin = F.greatest(F.col("start"), s["block"] * p("block")) - F.col("start")
            end = F.least(F.col("start") + F.col("size"), s["block"] * p("block") + room) - F.col("start")
            return F.struct(F.pmod(s["pool"] + turn, F.lit(shards)).cast("int").alias("shard"), turn.cast("int").alias("pass"), begin.alias("first"), end.alias("end"))

        return F.transform(F.sequence(F.lit(0), p("whole")), piece)

    rows = rows.withColumn("_last_pool", last_pool)
    taken = F.filter(F.flatten(F.transform(spots, pieces_of)), lambda x: x["first"] < x["end"])
    made = F.struct(p("source_size").alias("source_size"), p("target").alias("target"), "start", taken.alias("pieces"))
    return rows.select("_row", made.alias("_made")).select("_row.*", "_made.*")


def taken_words(pieces: Column) -> Column:
    return F.coalesce(F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["first"]), F.lit(0).cast("long"))


def shuffled(rows: DataFrame, count: int, *key: str, seed: int = SEED) -> DataFrame:
    """Rows with a ``shard``, in random order inside each shard, of about ``count`` rows in all.

    A shard is ordered in parts of about ``LOCAL_ROWS`` rows, chosen by the same hash.
    """
    order = F.xxhash64(*key, F.lit(seed + 1))
    parts = max(1, count // (LOCAL_ROWS * SHARDS))
    return rows.withColumn("_order", order).withColumn("_part", F.pmod("_order", F.lit(parts))).repartition("shard", "_part").sortWithinPartitions("shard", "_part", "_order").drop("_order", "_part")


def shuffled_pieces(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, doc_id, pass, first and end word, in random order inside each shard."""
    rows = mixed.select("doc_id", F.explode("pieces").alias("p")).select("p.shard", "doc_id", "p.pass", "p.first", "p.end")
    return shuffled(rows, 2 * mixed.count(), "doc_id", "pass", "first", seed=seed)


def mixed_documents(docs: DataFrame, seed: int = SEED, **settings) -> DataFrame:
    """Whole documents by the mix: each once for every piece that has its middle word, in the piece's shard.

    So a document is repeated once for each whole pass and once more if its
    block is drawn again, and texts are never cut. A shard's documents come in
    parts, each in random order, which lie over the partitions. The mix itself is of ids and sizes; texts
    are joined to what it picked, and move when the shards are dealt out.
    """
    carried = docs.columns
    rows = docs.select("doc_id", hashed(docs).alias("_tie"), F.struct(*carried).alias("_whole"))
    narrow = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hashed(docs).alias("_tie")), "sizes")
    again = written(narrow.groupBy("doc_id", "_tie").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("_tie").alias("_same")), "again")
    if not again.isEmpty():
        # Rows that are the same in all columns are one here; each of them was picked for itself.
        repeated, same = broadcast_if_small(again), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_same"))
        single = rows.join(repeated, same, "left_semi").groupBy("doc_id", "_tie").agg(F.first("_whole").alias("_whole"))
        rows = rows.join(repeated, same, "left_anti").union(single)
    middle = F.floor(F.col("size") / 2)
    picked = mix(narrow, seed=seed, **settings).select("doc_id", "_tie", "start", F.explode(F.filter("pieces", lambda p: (p["first"] <= middle) & (p["end"] > middle))).alias("p"))
    picked = written(picked.select(F.col("doc_id").alias("_id"), F.col("_tie").alias("_same"), "p.shard", F.xxhash64("doc_id", "start", "p.pass").alias("_pick")), "picked")
    out = rows.join(broadcast_if_small(picked), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_same")))
    return shuffled(out.select("_whole", "shard", "_pick"), picked.count(), "_pick", seed=seed).select("_whole.*")


def op10_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of every document, and by which shards (``dealt``: shard:words, comma-joined)."""
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    by = F.transform(F.array_sort("pieces"), lambda p: F.concat_ws(":", p["shard"].cast("string"), (p["end"] - p["first"]).cast("string")))
    return mix(docs).select("doc_id", "size", "source_size", "target", taken_words(F.col("pieces")).alias("taken"), F.array_join(by, ",").alias("dealt"))


QUERIES = {"op10_splitting_tree_mix": op10_splitting_tree_mix}
ORACLE_SQL: dict[str, str] = {}
