"""Importance resampling towards a target: array-scored weights, then a distributed quickselect.

Features are runs of words, hashed into buckets. Two arrays of bucket counts,
of the documents and of the target texts, give an array of gains; a document's
weight is the sum of the gains of its features. Tasks count into arrays of
their own, so what is shuffled is a row a task and bucket, and the arrays have
a fixed number of entries whatever the input.

The draw is Gumbel top-k: a weight plus Gumbel noise from a hash of the id is
a score, and the highest scores are a sample without replacement in proportion
to exp(weight / 1000). The k-th score is found by quickselect over a written
table of narrow rows: random pivot keys, exact counts of the rows before, at
and after each, then only the rows between two neighbouring pivots are left.
Only the winners are sorted, in ranges, and ranked.

Words: A-Z are lower-cased; a word is a run of digits, a-z and characters
beyond ASCII.

Defined cases: a null or empty text has no features and the weight 0; a null
id takes part under the empty name; rows that repeat an id are rows of their
own, told apart by a number of the row, so ties are cut exactly; without
documents of enough words nothing is drawn; an empty target makes all buckets'
gains depend on the documents alone; a share of all or more draws all; columns
with the name of an output are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from vicinal.llm.common import written
from vicinal.session import table

BUCKETS, LONGEST_RUN = 10_000, 1
LEAST_WORDS, PER_CENT, SEED = 20, 10, 2024
#: Pivots a round of the quickselect.
PIVOTS = 32
#: Bytes of features that a task remembers the buckets of.
CACHE_BYTES = 64 << 20
OUTPUTS = ("n_features", "n_words", "weight", "score", "rank")

#: Of bytes: A-Z become a-z; other ASCII but digits and a-z become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode().translate(_WORDS).split()


class Buckets(dict):
    """feature -> bucket, remembered up to a number of bytes."""

    def __init__(self, buckets: int, room: int = CACHE_BYTES) -> None:
        super().__init__()
        self.buckets, self.room = buckets, room

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        self.room -= len(feature) + 120
        if self.room > 0:
            self[feature] = bucket
        return bucket

    def of(self, text: str | None, longest: int) -> tuple[int, np.ndarray]:
        """The number of words of a text and the buckets of all its features."""
        w = words(text)
        found = list(map(self.__getitem__, w))
        for n in range(2, longest + 1):
            found += [self[b" ".join(w[i : i + n])] for i in range(len(w) - n + 1)]
        return len(w), np.array(found, np.int64)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """The features of all texts, counted by bucket: an array of fixed size, from sums that tasks make of their own rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                own += np.bincount(known.of(value.as_py(), longest)[1], minlength=buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], names=["bucket", "n"])

    rows = texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share of the target over its share of the source, both with one more in every bucket."""
    buckets, total, wanted = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (total + buckets) / ((float(s) + 1) * (wanted + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", longest: int = LONGEST_RUN, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the carried columns, by default all but the text), n_features, n_words, weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    carried = [c for c in docs.columns if c != text] if carry is None else carry
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried if c not in OUTPUTS)).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        known = Buckets(len(g))
        for batch in batches:
            counts = np.zeros((3, batch.num_rows), np.int64)
            for i, value in enumerate(batch.column(1)):
                n, found = known.of(value.as_py(), longest)
                counts[:, i] = len(found), n, g[found].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts)], names=["row", "n_features", "n_words", "weight"])

    kind = StructType(rows.schema.fields[:1]).add("n_features", LongType()).add("n_words", LongType()).add("weight", LongType())
    return rows.mapInArrow(run, kind)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u in (0, 1) from a hash of the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def _literal(key: Row, kinds: StructType) -> Column:
    return F.struct(*(F.lit(key[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields))


def kth_key(rows: DataFrame, k: int, key: str = "key", pivots: int = PIVOTS) -> Row | None:
    """The k-th smallest (from 1) of the distinct struct keys of ``rows`` (a written table with a column ``tie``), by quickselect.

    A round draws pivots by a hash, counts the rows before and at each, and
    keeps the rows between the two pivots that the k-th lies between, as a
    written table. The driver sees pivots and counts only.
    """
    kinds, rest, turn = rows.schema[key].dataType, rows.select(key, "tie"), 0
    while True:
        turn += 1
        drawn = [r[key] for r in rest.orderBy(F.xxhash64("tie", F.lit(turn)), "tie").limit(pivots).select(key).sort(key).collect()]
        if not drawn:
            return None
        at = [_literal(p, kinds) for p in drawn]
        counted = rest.agg(*(F.count_if(F.col(key) < p).alias(f"less{i}") for i, p in enumerate(at)), *(F.count_if(F.col(key) == p).alias(f"same{i}") for i, p in enumerate(at))).first()
        low = high = None
        for i in range(len(drawn)):
            less, same = counted[f"less{i}"], counted[f"same{i}"]
            if less < k <= less + same:
                return drawn[i]
            if k > less + same:
                low = i
            elif high is None:
                high = i
        if low is None and high is None:
            return None
        if low is not None:
            k -= counted[f"less{low}"] + counted[f"same{low}"]
            rest = rest.filter(F.col(key) > at[low])
        if high is not None:
            rest = rest.filter(F.col(key) < at[high])
        rest = written(rest, "select")


def ranked(winners: DataFrame, key: str = "key", name: str = "rank") -> DataFrame:
    """``winners`` with their place (from 1) in the order of the key: sorted in ranges, each numbered after those before it.

    The table of ranges has a row a partition.
    """
    ranged = written(winners.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "winners")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_range", "_inside", "_before")


def resample(
    docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED, carry: list[str] | None = None,
) -> DataFrame:
    """The carried columns of every document (doc_id, text, ...; by default all but the text) with n_features, n_words, weight, score and rank.

    Of the N documents with at least ``least_words`` words, floor(per_cent * N
    / 100) have a rank; it is null for the others. ``target`` has a column text.
    """
    gain = gains(bucket_counts(docs, buckets=buckets, longest=longest), bucket_counts(target, buckets=buckets, longest=longest))
    carry = [c for c in docs.columns if c != "text"] if carry is None else carry
    rows = weigh(docs, gain, longest=longest, carry=[*dict.fromkeys(["doc_id", *carry])])
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.col("row.doc_id"), seed)).withColumn("tie", F.monotonically_increasing_id())
    # Ascending order of the key is that of the ranks; the number of the row makes keys distinct.
    rows = written(rows.withColumn("key", F.struct((-F.col("score")).alias("s"), F.col("row.doc_id").alias("d"), F.col("n_features").alias("n"), F.col("tie").alias("t"))), "scored")
    eligible = rows.filter(F.col("n_words") >= least_words)
    k = min(100, per_cent) * eligible.count() // 100
    last = kth_key(eligible, k) if k else None
    won = (F.col("n_words") >= least_words) & (F.col("key") <= _literal(last, rows.schema["key"].dataType)) if last is not None else F.lit(False)
    out = ranked(rows.filter(won)).unionByName(rows.filter(~won).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(*(F.col(f"row.`{c}`") for c in carry if c not in OUTPUTS), *OUTPUTS)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the benchmark's words; a tenth of those of 20 words or more is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: CRC-32 byte by byte over a table of 256 remainders, for the distinct words.
_SQL = f"""WITH d AS (SELECT doc_id, {_SPLIT} AS ws FROM documents), b AS (SELECT {_SPLIT} AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
v AS (SELECT w, list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw))),
k AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (w) GROUP BY bucket),
g AS (SELECT r.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS})))) AS BIGINT) AS gain
    FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
x AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN x USING (doc_id)),
p AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PER_CENT} * (SELECT count(*) FROM e WHERE n_features >= {LEAST_WORDS}) // 100 THEN place END AS rank FROM p"""

QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLE_SQL = {"op12_importance_resampling": _SQL}
