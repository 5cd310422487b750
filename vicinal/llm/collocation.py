"""Phrase collocations by stripes.

A stripe belongs to a prefix of words and counts the words that come next.
Phrases of one word more are its entries, the prefix's own count is its total
(an entry without a word counts the places where the prefix ends a piece or
goes on in a way that is too rare), and its largest entry tells whether the
prefix stands in a longer phrase just as often. So one structure, merged entry
by entry, gives extensions, totals and the maxima that a phrase is dropped by.

Lengths are counted one after the other. A phrase of n words occurs no more
often than its first and its last n - 1 words, so a place is counted only if
both are frequent. Tasks look that up in an array of bits over hashes, of a
fixed size whatever the number of frequent phrases: a hash that is taken by
chance lets a rare phrase be counted, and its exact count drops it. Texts are
cut into words once and written as numbers of words, in units that have a list
of their own words. Tasks put units together to chunks and count them with
arrays, by word numbers, so no two phrases are mixed up. Stripes are dealt into
parts by a hash of their prefix, and a task sends one row a chunk and part.
Prefixes that have more than one in ``HOT_SHARE`` of all words, which are that
many at most, have their stripes cut over all parts by the next word, as has
the empty prefix.

Everything is counted by lang. Texts have A-Z lower-cased, are split into
pieces at ``. , ; : ! ?`` and line ends, and those at spaces and tabs into words.

A candidate has 2 to ``longest`` words and occurs at least ``least`` times. Cut
after k words it has the score floor(1000 * a * n / (l * r)): a, l and r are
the counts of the whole, the first part and the rest, n that of all words. The
lowest-scoring cut counts, then the smallest k. Products are exact decimals of
38 digits. A candidate is dropped if it stands inside a longer one with at
least ``share`` per cent of its count; one word more, before or after, decides,
for a phrase between the two is at least as frequent as the longer one.

Defined cases: a null text is empty, a null lang ``und``; without texts, or
without frequent words, there are no phrases; ties are ranked by count and then
by the phrase's bytes; a document given twice counts twice; only lang and text
are read of any further columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.llm.common import BROADCAST_ROWS, partitions, written
from vicinal.session import new_path, table

LONGEST, LEAST, SHARE, MOST = 5, 100, 100, 2000
#: Bits of the array of frequent phrases.
FILTER_BITS = 1 << 27
#: Bytes of text in a unit, small enough for the JVM to hold its columns as ordinary objects; words that a task counts at once. Of all langs together a task holds at most so many times as much.
UNIT, CHUNK, HELD = 1 << 18, 2 << 20, 2
#: A prefix with more than one in so many of all words has its stripe cut. Parts into which stripes are dealt, at least.
HOT_SHARE, PARTS = 2048, 1024
UNITS = "lang string, size bigint, words binary, width int, ids binary"
#: Of a part's stripes the prefixes, next words and counts: a line a stripe, words and counts separated by spaces, as no word
#: holds either. An empty word stands where the prefix ends a piece or goes on too rarely.
STRIPES = "lang string, part int, prefixes string, next string, n string"
#: The end of a piece among the words; no byte of UTF-8.
_END = b"\xff"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Of bytes: A-Z become a-z, tabs spaces, ends of pieces _END.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


#: Bytes of phrases in a table that is sent to all tasks.
BROADCAST_BYTES = 64 << 20
#: A written table needs no shuffle files any more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, compressed more closely; the shuffle files that it took are removed once it is written."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def phrase_hash(lang: str, phrase: bytes) -> int:
    """The hash by which tasks know a phrase of a lang."""
    out, seed = 0, _seed(lang)
    for word in phrase.split(b" "):
        out = (out * int(_FACTOR) + xxhash.xxh64_intdigest(word, seed)) % (1 << 64)
    return out


class Bits:
    """An array of bits over hashes; true for all that were put in, and by chance for others."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(20)
        at %= np.uint64(64 * len(self.words))
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def frequent_bits(phrases: DataFrame, bits: int = FILTER_BITS) -> Bits:
    """The bits of a table with a column h; put together by tasks, so at most bits / 64 numbers reach the driver."""
    at = F.pmod(F.shiftrightunsigned("h", 20), F.lit(bits).cast("bigint"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))
    rows = phrases.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return Bits(words)


def encoded(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The distinct words of texts, joined by spaces, and the texts as numbers of words from 1; 0 ends a piece."""
    words = (_END.join(texts) + _END).translate(_BYTES).replace(_END, b" \xff ").split()
    number: dict[bytes, int] = {_END: 0}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    return b" ".join(list(number)[1:]), ids.astype(np.uint16) if len(number) <= 1 << 16 else ids


class Chunk:
    """Units of one lang: ids of words (0 ends a piece), how many words of its piece are left at each place, hashes."""

    def __init__(self, lang: str, units: list[tuple[bytes, np.ndarray]]) -> None:
        number: dict[bytes, int] = {_END: 0}
        parts = []
        for words, ids in units:
            own = words.split(b" ") if words else []
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in (_END, *own)), np.int32, len(own) + 1)[ids])
        self.ids = np.concatenate(parts)
        place = np.arange(len(self.ids), dtype=np.int32)
        ends = np.where(self.ids == 0, place, np.int32(len(self.ids)))
        self.left = np.minimum.accumulate(ends[::-1])[::-1] - place
        self.words = pa.array([b"", *list(number)[1:]], pa.binary())
        seed = _seed(lang)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in number), np.uint64, len(number))

    def phrase_hashes(self, n: int) -> np.ndarray:
        """Of the n words from each place on (without meaning where a piece has fewer left)."""
        h = self.hashes[self.ids]
        out = h.copy()
        for k in range(1, n):
            out *= _FACTOR
            out[: max(0, len(h) - k)] += h[k:]
        return out

    def first_stripe(self, parts: int) -> tuple[np.ndarray, ...]:
        """The entries of the empty prefix: each one's part, next word, count and (no) prefix."""
        found = np.arange(1, len(self.words), dtype=np.int32)
        return (self.hashes[1:] % np.uint64(parts)).astype(np.int32), found, np.bincount(self.ids, minlength=len(self.words))[1:], np.zeros((0, len(found)), np.int32)

    def entries(self, size: int, frequent: Bits, hot: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
        """The entries of prefixes of ``size`` words: each one's part, next word, count and prefix (columns of ids), prefix by prefix."""
        h = self.phrase_hashes(size)
        good = self.left >= size
        good[good] = frequent.has(h[good])
        at = np.flatnonzero(good)
        after = np.append(good[1:], False)[at] & (self.left[at] > size)
        follow = np.where(after, self.ids[np.minimum(at + size, len(self.ids) - 1)], np.int32(0))
        columns = np.array([*(self.ids[at + k] for k in range(size)), follow])
        order, first = _groups(h[at] * _FACTOR + self.hashes[follow], columns)
        counts = np.diff(first, append=len(at))
        columns, h = columns[:, order[first]], h[at][order[first]]
        part = ((h + np.where(np.isin(h, hot), self.hashes[columns[-1]], np.uint64(0))) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(h, kind="stable")
        return part[order], columns[-1][order], counts[order], columns[:-1, order]

    def rows(self, lang: str, part: np.ndarray, follow: np.ndarray, counts: np.ndarray, prefix: np.ndarray) -> pa.RecordBatch:
        """The entries as stripes, in rows of ``STRIPES``."""
        order = np.argsort(part, kind="stable")
        part, follow, counts, prefix = part[order], follow[order], counts[order], prefix[:, order]
        row = np.ones(len(order), bool)
        row[1:] = part[1:] != part[:-1]
        # Stripes of one prefix that a collision of hashes keeps apart are merged with all others.
        stripe = row.copy()
        stripe[1:] |= (prefix[:, 1:] != prefix[:, :-1]).any(axis=0)
        first, starts = np.flatnonzero(stripe), np.flatnonzero(row)
        ends = lambda begin, n: pa.array(np.append(begin, n), pa.int32())
        joined = lambda values: pc.binary_join(pa.ListArray.from_arrays(ends(first, len(follow)), values), " ")
        parts = [self.words.take(pa.array(c[first])) for c in prefix]
        names = pc.binary_join_element_wise(*parts, b" ") if parts else pa.array([b""] * len(first), pa.binary())
        lines = ends(np.searchsorted(first, starts), len(first))
        own = (names.cast(pa.string()), joined(self.words.take(pa.array(follow)).cast(pa.string())), joined(pa.array(counts, pa.int64()).cast(pa.string())))
        columns = [pc.binary_join(pa.ListArray.from_arrays(lines, c), "\n") for c in own]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(starts), pa.string()), pa.array(part[starts], pa.int32()), *columns], names=["lang", "part", "prefixes", "next", "n"])


def _groups(keys: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal columns stand together, and where each group begins; keys are hashes of the columns."""
    order = np.argsort(keys)
    changed = np.ones(len(order), bool)
    differ = lambda o: (columns[:, o[1:]] != columns[:, o[:-1]]).any(axis=0)
    changed[1:] = differ(order)
    if (changed[1:] & (keys[order[1:]] == keys[order[:-1]])).any():  # two phrases with one hash
        order = np.lexsort(columns)
        changed[1:] = differ(order)
    return order, np.flatnonzero(changed)


def _gathered(rows: Iterator[tuple[str, int, object]], enough: int, most: int) -> Iterator[tuple[str, list]]:
    """(lang, items) of (lang, size, item): lists of about ``enough`` in size, fewer where many langs would hold more than ``most``."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    total = 0
    for lang, n, item in rows:
        held.setdefault(lang, []).append(item)
        size[lang] = size.get(lang, 0) + n
        total += n
        full = lang if size[lang] >= enough else max(size, key=size.get) if total >= most else None
        if full is not None:
            total -= size.pop(full)
            yield full, held.pop(full)
    yield from held.items()


def units(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` (lang, text) as rows of ``UNITS``, a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((lang, len(value) + 64, value) for b in batches for lang, value in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True))
        for lang, own in _gathered(texts, UNIT, HELD * 8 * UNIT):
            words, ids = encoded(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(ids)], pa.int64()), pa.array([words], pa.binary()), pa.array([ids.itemsize], pa.int32()), pa.array([ids.tobytes()], pa.binary())], names=["lang", "size", "words", "width", "ids"])

    text = F.col("text").cast("string").cast("binary").alias("text")
    return stored(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text).filter("text is not null").mapInArrow(run, UNITS), "units")


def _sent(texts: DataFrame, count: Callable[[Chunk], tuple[np.ndarray, ...]]) -> DataFrame:
    """The stripes that tasks make of their own units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column(0)[i].as_py(), b.column(1)[i].as_py(), (b.column(2)[i].as_py(), np.frombuffer(b.column(4)[i].as_buffer(), f"u{b.column(3)[i].as_py()}"))) for b in batches for i in range(b.num_rows))
        for lang, own in _gathered(rows, CHUNK, HELD * CHUNK):
            chunk = Chunk(lang, own)
            yield chunk.rows(lang, *count(chunk))

    return texts.select("lang", "size", "words", "width", "ids").mapInArrow(run, STRIPES)


def merged(sent: DataFrame, least: int) -> DataFrame:
    """lang, prefix, total, best, next: stripes merged entry by entry, in one shuffle by part; a cut prefix has a row a part.

    total counts the prefix, best is the largest entry, next has the entries of
    at least ``least``. Entries are summed and sorted with spilling, never held whole.
    """
    lines = F.arrays_zip(*(F.split(c, "\n").alias(c) for c in ("prefixes", "next", "n")))
    follow = lambda s: F.split(s["next"], " ")
    pairs = lambda s: F.arrays_zip(F.array_repeat(s["prefixes"], F.size(follow(s))).alias("prefix"), follow(s).alias("next"), F.split(s["n"], " ").alias("n"))
    entries = F.explode(F.flatten(F.transform(lines, pairs)))
    by = ("lang", "part", "prefix")
    sums = sent.repartition("lang", "part").select("lang", "part", entries.alias("e")).groupBy("lang", "part", F.col("e.prefix").alias("prefix"), F.col("e.next").alias("next")).agg(F.sum(F.col("e.n").cast("bigint")).alias("n"))
    word = F.col("next") != ""
    kept = F.collect_list(F.when(word & (F.col("n") >= least), F.struct("next", "n")))
    return sums.groupBy(*by).agg(F.sum("n").alias("total"), F.max(F.when(word, F.col("n"))).alias("best"), kept.alias("next")).drop("part")


def phrases(stripes: DataFrame) -> DataFrame:
    """lang, phrase, a, h, prefix of the frequent extensions."""
    rows = stripes.select("lang", "prefix", F.explode("next").alias("e"))
    rows = rows.select("lang", F.when(F.col("prefix") == "", F.col("e.next")).otherwise(F.concat_ws(" ", "prefix", "e.next")).alias("phrase"), F.col("e.n").alias("a"), "prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.fromiter(map(phrase_hash, b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.view(np.int64))], names=[*b.schema.names, "h"])

    return rows.mapInArrow(run, "lang string, phrase string, a bigint, prefix string, h bigint")


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = FILTER_BITS) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(lang, n of all words), and by length the frequent phrases (lang, phrase, a, prefix, h) and the merged stripes they come from, as written tables."""
    spark = docs.sparkSession
    texts, parts = units(docs), max(PARTS, 4 * partitions(spark))
    stripes = [stored(merged(_sent(texts, lambda c: c.first_stripe(parts)), least), "stripes")]
    totals = written(stripes[0].groupBy("lang").agg(F.sum("total").alias("n")), "words")
    found = [written(phrases(stripes[0]), "phrases")]
    every = totals.agg(F.sum("n")).first()[0] or 0
    for size in range(1, longest):
        if found[-1].isEmpty():
            break
        hot = np.array([r["h"] for r in found[-1].filter(F.col("a") > every // HOT_SHARE).select("h").collect()], np.int64).view(np.uint64)
        shared = spark.sparkContext.broadcast((frequent_bits(found[-1], bits), hot))
        count = lambda c, size=size, shared=shared: c.entries(size, *shared.value, parts)
        stripes.append(stored(merged(_sent(texts, count), least), "stripes"))
        found.append(written(phrases(stripes[-1]), "phrases"))
        shared.unpersist()
    return totals, found, stripes


def _bounded(table: DataFrame, column: str) -> DataFrame:
    """A written table, sent to all tasks if its rows and the bytes of its phrases are few; words may be very long."""
    size = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(table) if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES else table


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, most: int = MOST, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first ``most`` phrases of ``docs`` (lang, text)."""
    totals, found, stripes = count_phrases(docs, longest, least, bits)
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    kind = "lang string, phrase string, a bigint, prefix string, h bigint"
    spark = docs.sparkSession
    candidates = union(found[1:]) if len(found) > 1 else spark.createDataFrame([], kind)
    prefixes = union(stripes[1:]).groupBy("lang", F.col("prefix").alias("part")).agg(F.sum("total").alias("f"), F.max("best").alias("best")) if len(found) > 1 else spark.createDataFrame([], "lang string, part string, f bigint, best bigint")
    # The largest extension to the right is in the stripe; that to the left is gathered by the rest.
    longer = candidates.withColumn("part", F.regexp_replace("phrase", "^[^ ]* ", "")).groupBy("lang", "part").agg(F.max("a").alias("best"))
    longer = longer.unionByName(prefixes.select("lang", "part", "best")).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("best").alias("best"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(F.col("best").isNull() | (100 * F.col("best") < share * F.col("a")))
    # A prefix's own count is its stripe's total; the other parts are shorter phrases.
    kept = written(kept.select("lang", "phrase", "a", "prefix"), "kept")
    counts = written(union(found).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), "counts")
    stripe_totals = written(prefixes.select("lang", F.col("part").alias("prefix"), F.col("f").alias("prefix_f")), "totals")
    words = F.split("phrase", " ")
    size = F.size(words)
    joined = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = kept.join(_bounded(stripe_totals, "prefix"), ["lang", "prefix"]).withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.col("k") + 1, size).alias("rest"), F.when(F.col("k") < size - 1, joined(F.lit(1), F.col("k"))).alias("first"), "prefix_f")
    counts = _bounded(counts, "part")
    r = counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    left = counts.select("lang", F.col("part").alias("first"), F.col("f").alias("first_f"))
    cuts = cuts.join(r, ["lang", "rest"]).join(left, ["lang", "first"], "left").withColumn("l", F.coalesce("first_f", "prefix_f"))
    cuts = cuts.join(_bounded(totals, "lang"), "lang")
    # Counts have at most 16 digits, so all products are exact in 38.
    score = F.expr("(1000BD * cast(cast(a as decimal(16,0)) * cast(n as decimal(16,0)) as decimal(32,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= most)
    return top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each lang of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM d), t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, range(1, {LONGEST + 1}) r(m))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
x AS (SELECT s.lang, s.phrase FROM f s JOIN f b ON s.lang = b.lang AND b.m > s.m AND s.m > 1 AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.f >= {SHARE} * s.f),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND (lang, phrase) NOT IN (SELECT (lang, phrase) FROM x)),
k AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.first JOIN f r ON r.lang = k.lang AND r.phrase = k.rest JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {MOST}"""

QUERIES = {"op11_phrase_stripes": op11_phrase_stripes}
ORACLE_SQL = {"op11_phrase_stripes": _SQL}
