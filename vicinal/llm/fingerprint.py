"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A k-mer of ``K`` code points is a closed syncmer if the smallest hash of its
inner substrings of ``S`` code points lies at its first or last place. Whether
it is one depends on the k-mer alone, not on what surrounds it, so the same
passage gives the same anchors in any text, and the anchors of a text that was
pieced together are those of its pieces and of the few k-mers over the seam.

Functions of array elements are interpreted, projections are compiled. So texts
are cut, in one pass, into overlapping chunks, a row each; the inner substrings
of a chunk are columns, and so are the tests of its k-mers. A text's chunks are
put together again in the same task. The hash of a k-mer combines those of its
first and last inner substrings, which cover it. A fingerprint is the bottom-m
sketch of the set of anchor hashes: the ``SIZE`` smallest, in hexadecimal. The
likeness of two fingerprints is the bottom-m estimate of the Jaccard
similarity of the anchor sets, which is exact for sets of up to SIZE anchors.

Anchors also match by position: ``anchors`` gives their places and hashes, and
of an edited text those are counted that the text itself has at the same place.

Neighbours in descending order of ids are found without a global sort: ids are
cut into ranges of about ``BUCKET_ROWS`` rows, and the first row of every range
is also sent to the range before it. Texts are shuffled once. Rows without an id
are cut into ranges by a hash of their texts.

Defined cases: a null text counts as empty; a text shorter than K has one
anchor, the whole text, and an empty text none; two empty fingerprints have
likeness 1, an empty and another 0; null ids come last, in the order of their
texts' hashes; rows that repeat an id are ordered by that hash and their texts,
and lie in one range; the only document is its own next one; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.llm.common import broadcast_if_small, written
from vicinal.session import table

K, S = 15, 8
#: K-mers begin so often in a chunk, inner substrings in a part of it, which is counted off from its start.
#: The columns of a chunk are more than Spark fuses into one method (100), which would be too long for the JVM to compile.
CHUNK, PART = 96, 16
SIZE = 64
BUCKET_ROWS = 100
#: Ranges of ids at most: beyond some 100 million rows, ranges grow.
MOST_BUCKETS = 1 << 20
#: Ids are cut at so many quantiles, and evenly between two quantiles.
QUANTILES = 128
#: The places of inner substrings in a k-mer; first and last must cover it.
LAST = K - S
assert LAST <= S


def _closed(first: Column, last: Column, between: Column) -> Column:
    """Whether the smallest hash of a k-mer is its first or its last one."""
    return F.least(first, last) <= between


def chunk_anchors(df: DataFrame, text: str) -> DataFrame:
    """The columns of ``df``; its non-null text stays in one row (``_chunk`` 0) of several. ``_at`` and ``_hash`` have the places (from 0) and hashes of the closed syncmers.

    Chunks are numbered from 1. A text of fewer than K code points has its anchor in row 0.
    """
    keys = [c for c in df.columns if c != text]
    # Each chunk takes the beginning of the next along.
    chunks = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{CHUNK + K - 1}}})).{{1,{CHUNK}}}"), F.lit(1))
    rows = df.select(*keys, F.posexplode(F.concat(F.array(text), chunks)).alias("_chunk", text))
    keys += ["_chunk", text]
    size, inside = F.length(text), F.col("_chunk") > 0
    inner = range(CHUNK + LAST)
    # Columns of their own, each used more than once, so the optimizer does not put one inside the next.
    rows = rows.select(*keys, F.when(inside, size).otherwise(0).alias("_size"), *(F.when(inside, F.substring(text, i + 1, PART + S - 1)).alias(f"_part{i // PART}") for i in inner[::PART]))
    rows = rows.select(*keys, "_size", *(F.xxhash64(F.substring(f"_part{i // PART}", i % PART + 1, S)).alias(f"_inner{i}") for i in inner))
    h = [F.col(f"_inner{i}") for i in inner]
    found = [(F.col("_size") >= i + K) & _closed(h[i], h[i + LAST], F.least(*h[i + 1 : i + LAST])) for i in range(CHUNK)]
    short = ~inside & (size > 0) & (size < K)
    # No condition around these arrays: within one, the tests would be done for each of both.
    at = F.array_remove(F.array(F.when(short, 0).otherwise(-1), *(F.when(f, (F.col("_chunk") - 1) * CHUNK + i).otherwise(-1) for i, f in enumerate(found))), -1)
    none = F.array().cast("array<bigint>")
    hashes = F.flatten(F.array(F.when(short, F.array(F.xxhash64(text))).otherwise(none), *(F.when(f, F.array(F.xxhash64(h[i], h[i + LAST]))).otherwise(none) for i, f in enumerate(found))))
    return rows.select(*keys[:-1], F.when(~inside, F.col(text)).alias(text), at.alias("_at"), hashes.alias("_hash"))


def with_anchors(df: DataFrame, text: str, at: str, hashes: str) -> DataFrame:
    """``df`` with the places and hashes of the closed syncmers of a non-null text column.

    No shuffle, if ``df`` is dealt out by columns of its own.
    """
    keys = [*(c for c in df.columns if c != text), "_row"]
    rows = chunk_anchors(df.withColumn("_row", F.monotonically_increasing_id()), text)
    rows = rows.groupBy(*keys).agg(F.max(text).alias(text), F.sort_array(F.collect_list(F.struct("_chunk", "_at", "_hash"))).alias("_chunks"))
    return rows.select(*keys[:-1], text, F.flatten("_chunks._at").alias(at), F.flatten("_chunks._hash").alias(hashes))


def with_short_anchors(df: DataFrame, text: str, at: str, hashes: str) -> DataFrame:
    """The same for texts of a few words, which stay in their rows."""
    size, h = F.length(text), lambda i: F.get("_inner", i)
    df = df.withColumn("_inner", F.transform(F.sequence(F.lit(0), F.greatest(size - S, F.lit(0))), lambda i: F.xxhash64(F.substring(text, i + 1, F.lit(S)))))
    found = F.filter(F.sequence(F.lit(0), F.greatest(size - K, F.lit(0))), lambda i: _closed(h(i), h(i + LAST), F.array_min(F.slice("_inner", i + 2, LAST - 1))))
    df = df.withColumn(at, F.when(size >= K, found).when(size > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    joined = F.transform(at, lambda i: F.xxhash64(h(i), h(i + LAST)))
    return df.withColumn(hashes, F.when(size >= K, joined).when(size > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))).drop("_inner")


def sketch(hashes: Column) -> Column:
    """The smallest distinct hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SIZE)


def fingerprint(sketch_column: Column) -> Column:
    return F.array_join(F.transform(sketch_column, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of the smallest hashes of both together, the share that both have."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place, hash of every anchor, for positional matching."""
    rows = chunk_anchors(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), "_text")
    return rows.select("doc_id", F.explode(F.arrays_zip("_at", "_hash")).alias("a")).select("doc_id", F.col("a._at").alias("place"), F.col("a._hash").alias("hash"))


def id_ranges(docs: DataFrame) -> tuple[Column, DataFrame]:
    """The number of the range of a row (doc_id, hash), and for the first (largest) id of each range the range before it.

    Ranges are numbered by descending id. One light pass reads ids, and the hashes of rows without one.
    """
    seen = docs.agg(F.count(F.lit(1)).alias("every"), F.count("doc_id").alias("n"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    per = max(1, min(-(-(seen["n"] or 0) // (QUANTILES * BUCKET_ROWS)), MOST_BUCKETS // QUANTILES))
    cuts = sorted({*(seen["q"] or [0]), *([seen["lo"]] if seen["n"] else [])})
    widths = [max(1, -(-(b - a) // per)) for a, b in zip(cuts, [*cuts[1:], (seen["hi"] or 0) + 1], strict=True)]
    cut = F.greatest(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))) - 1, F.lit(0))
    start = F.element_at(F.array(*[F.lit(c).cast("long") for c in cuts]), cut + 1)
    width = F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), cut + 1)
    inner = F.least((F.col("doc_id") - start) / width, F.lit(per - 1)).cast("long")
    # Descending: the largest ids are range 0. Null ids are ranges after all others, by the upper bits of their hash.
    nulls = max(1, min(-(-(seen["every"] - (seen["n"] or 0)) // BUCKET_ROWS), MOST_BUCKETS))
    after = F.lit(len(cuts) * per + 1) + F.floor((F.shiftright(F.col("hash"), 32) + F.lit(2**31)) * F.lit(nulls) / F.lit(2**32))
    number = F.coalesce(F.lit(len(cuts) * per) - (cut * per + inner), after.cast("long"))
    # Of null ids all have the same, so the hash tells which is first.
    rank = F.struct(F.col("doc_id"), F.when(F.col("doc_id").isNull(), -F.col("hash").cast("decimal(20,0)")).alias("h"))
    firsts = docs.select(number.alias("range"), "doc_id", "hash").groupBy("range").agg(F.max(rank).alias("first"))
    around = Window.orderBy("range")
    firsts = firsts.withColumn("before", F.coalesce(F.lag("range").over(around), F.max("range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return number, firsts.select(F.col("range").alias("_range"), F.col("first.doc_id").alias("_first"), (-F.col("first.h")).cast("long").alias("_hash"), F.col("before").alias("_before"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its text with the later half replaced from the next document."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.when(F.col("doc_id").isNull(), F.xxhash64(text)).alias("hash"))
    number, firsts = id_ranges(docs)
    rows = docs.select("doc_id", "text", "hash", number.alias("range"))
    # The first rows of a range are sent to the range before as well, where they come last.
    same = (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("_first")) & F.col("hash").eqNullSafe(F.col("_hash"))
    places = F.array(F.struct("range", F.lit(0).alias("guest")), F.struct(F.col("_before").alias("range"), F.lit(1).alias("guest")))
    rows = rows.join(broadcast_if_small(written(firsts, "ranges")), same, "left").select("doc_id", "text", "hash", F.explode(F.when(F.col("_before").isNull(), F.slice(places, 1, 1)).otherwise(places)).alias("p"))
    rows = rows.select("doc_id", "text", F.col("hash").alias("order"), "p.range", "p.guest").repartition("range")
    rows = with_anchors(rows, "text", "at", "hash").withColumn("own", sketch(F.col("hash")))
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "order", "text")
    after = lambda c: F.lead(c).over(order).alias(f"next_{c}")
    rows = rows.select("*", *(after(c) for c in ("text", "at", "hash", "own"))).filter("guest = 0")

    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("half", F.floor(n / 2).cast("int")).withColumn("keep", (n - F.floor(n / 2)).cast("int"))
    rows = rows.withColumn("fill", F.least("half", F.length("next_text")).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("keep")), F.substring("next_text", F.lit(1), F.col("fill"))))
    # Anchors of the edited text: those within the kept part, those within the filled part, those over the seam.
    seam = F.greatest(F.col("keep") - (K - 1), F.lit(0))
    rows = rows.withColumn("_seam", F.substring("edited", seam + 1, F.least(F.col("keep"), F.lit(K - 1)) + F.least(F.col("fill"), F.lit(K - 1))))
    within = lambda at, room: F.size(F.filter(at, lambda p: p <= room - K))
    rows = rows.withColumn("n_kept", within("at", F.col("keep"))).withColumn("n_filled", within("next_at", F.col("fill")))
    rows = with_short_anchors(rows, "_seam", "_seam_at", "_seam_hash")
    # The seam of a text of fewer than K characters is the whole text, so is its one anchor; a seam of fewer in a longer text has none.
    over = F.when((F.col("keep") + F.col("fill") >= K) & (F.length("_seam") < K), 0).otherwise(F.size("_seam_at"))
    cut = lambda c, n: F.slice(c, F.lit(1), F.col(n))
    rows = rows.withColumn("n_over", over).withColumn("_changed", F.concat(cut("_seam_hash", "n_over"), cut("next_hash", "n_filled")))
    rows = rows.withColumn("changed", sketch(F.concat(cut("hash", "n_kept"), "_changed"))).withColumn("_rest", F.slice("hash", F.col("n_kept") + 1, F.size("hash")))
    # Anchors that the text and its edited text have at one place: all that lie in the kept part, and what the rest happens to repeat. Few texts repeat a hash at all.
    placed = lambda at, hashes: F.zip_with(at, hashes, lambda p, h: F.xxhash64(p, h))
    moved = F.concat(F.transform(cut("_seam_at", "n_over"), lambda p: p + seam), F.transform(cut("next_at", "n_filled"), lambda p: p + F.col("keep")))
    repeated = F.size(F.array_intersect(placed(F.slice("at", F.col("n_kept") + 1, F.size("at")), F.col("_rest")), placed(moved, F.col("_changed"))))
    aligned = F.col("n_kept") + F.when(F.arrays_overlap("_rest", "_changed"), repeated).otherwise(0)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        (F.col("n_kept") + F.size("_changed")).cast("long").alias("edited_anchors"), aligned.cast("long").alias("aligned_anchors"),
    )


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_edited(table(spark, sf_dir, "documents"))


QUERIES = {"op4_closed_syncmers": op4_closed_syncmers}
ORACLE_SQL: dict[str, str] = {}
