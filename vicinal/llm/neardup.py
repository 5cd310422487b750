"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Every document gets its set of word shingles (64-bit hashes), a digest of
   the set, a signature of ``BANDS * ROWS`` MinHash values and its band keys.
2. Documents with equal sets form a class, and only one of a class goes on.
3. Documents that share a band key are candidates. Inside a bucket of equal
   keys not all pairs are made: first every member is paired with the bucket's
   smallest id (a star), which joins groups of near copies by few links. What
   that leaves apart is paired with another member, drawn by a hash, and so on
   for ``STARS`` rounds.
4. Candidates are compared by batches of signature values. After each batch
   the posterior of the similarity (a Beta distribution from a uniform prior)
   bounds how likely the pair still is to reach the threshold; below the
   chosen miss probability it is pruned.
5. Survivors are confirmed on the full sets, by exact counting.
6. Links become connected components. Buckets whose members are still in more
   than one component go to another round that pairs members of different
   components, in blocks, so that no link between components is lost. Pairs
   inside one component cannot change the result and are skipped.

With bands of 6 rows, two documents of similarity 0.8 share no band with
probability (1 - 0.8**6) ** 42 = 3e-6.

Defined cases: a null or wordless text has an empty set, is linked with
nothing and stays; a null id stays outside all links; repeated rows are copies
of one another. Of rows that share an id and differ in text, the one with the
smallest digest speaks for the id, and all of them have its component. Of a
component the smallest id stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.common import broadcast_if_small, hashed, written
from vicinal.llm.components import components
from vicinal.session import table

BANDS, ROWS = 42, 6
#: Signature values compared at a time.
BATCH = 42
#: A pair at the threshold is pruned with at most about this probability a batch.
MISS = 1e-7
#: Side of a block of bucket members that one task compares.
BLOCK = 512
#: ... or fewer, so that a block has about so many shingles (8 bytes each) at most.
BLOCK_SHINGLES = 2_000_000
WORD_CACHE = 200_000
#: Rounds of stars before the members of a bucket meet in blocks.
STARS = 2


class _WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Only A-Z are lower-cased and only ASCII white space parts words, which is
    what ``bytes.lower`` and ``bytes.split`` do.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(ids))
    n = len(ids) - width + 1
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return np.unique(acc)


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest value of ``factor * shingle`` modulo 2**64 for each factor."""
    out = np.full(len(factors), np.uint64(2**64 - 1))
    step = 2048
    for at in range(0, len(shingles), step):
        np.minimum(out, np.multiply.outer(factors, shingles[at : at + step]).min(axis=1), out=out)
    return out


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in mins.reshape(bands, rows).T:
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + column)
    return acc.view(np.int64)


def prune_table(batches: list[int], threshold: float, miss: float) -> list[int]:
    """The fewest equal values, after each number compared, with which a pair goes on.

    Of n values m equal, a uniform prior gives the similarity a Beta(m + 1,
    n - m + 1) posterior, whose upper tail is a binomial sum:
    P(s >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in batches:
        total, m = 0.0, -1
        while m < n:
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 2) - math.lgamma(n - m + 1) + (m + 1) * math.log(threshold) + (n - m) * math.log1p(-threshold))
            if total > miss:
                break
            m += 1
        out.append(m + 1)
    return out


def plausible(a: np.ndarray, b: np.ndarray, threshold: float = 0.8, miss: float = MISS, batch: int = BATCH) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential test."""
    width = a.shape[1]
    steps = [*range(batch, width, batch), width]
    alive, equal, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in zip(steps, prune_table(steps, threshold, miss), strict=True):
        equal[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        alive, done = alive[equal[alive] >= least], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def signatures(column, width: int) -> np.ndarray:
    """A matrix from a column of packed 16-bit signature values."""
    raw = b"".join(x.as_py() for x in column)
    return np.frombuffer(raw, np.uint16).reshape(-1, width)


def sketch(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest, sig, bands of every document, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = _WordHash(), _multipliers(bands * rows)
        for batch in batches:
            sizes, digests, sigs, keys = [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), words, hashes)
                sizes.append(len(shingles))
                if not len(shingles):
                    digests.append(None), sigs.append(None), keys.append(None)
                    continue
                mins = minhashes(shingles, factors)
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sigs.append((_mix(mins) >> np.uint64(48)).astype(np.uint16).tobytes())
                keys.append(band_keys(mins, bands, rows))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "sig", "bands"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, sig binary, bands array<bigint>")
    return written(out, "sketches")


def restrict(rows: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose ``column`` is (or, as an anti-join, is not) the ``id`` of a written table of distinct ids."""
    ids = ids.select(F.col("id").alias("_id_of_restrict"))
    return rows.join(broadcast_if_small(ids), F.col(column) == F.col("_id_of_restrict"), how)


def endpoints(pairs: DataFrame) -> DataFrame:
    """The distinct ids of a table of pairs (a, b), as a written table."""
    return written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")


def survivors(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that the sequential test does not prune.

    Both sides of either join are tables, so Spark may split the pairs of a hub.
    """
    sigs = written(restrict(reps.select("doc_id", "n_shingles", "sig"), "doc_id", endpoints(pairs)), "signatures")
    side = lambda x: sigs.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").filter(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                width = len(batch.column(2)[0].as_py()) // 2
                kept = plausible(signatures(batch.column(2), width), signatures(batch.column(3), width), threshold)
                yield batch.select(["a", "b"]).filter(pa.array(kept))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


class Ids:
    """Repeated ids: which row of an id speaks for it."""

    def __init__(self, named: DataFrame) -> None:
        again = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("_digest")).filter("n > 1")
        self.again = written(again.select(F.col("doc_id").alias("_id"), "_digest"), "again")
        self.repeated = not self.again.isEmpty()

    def with_digest(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, digest, ...) with the id's digest as ``digest`` and the row's own as ``own``."""
        if not self.repeated:
            return rows.withColumn("own", F.col("digest"))
        both = rows.join(broadcast_if_small(self.again), F.col("doc_id") == F.col("_id"), "left")
        return both.withColumn("own", F.col("digest")).withColumn("digest", F.coalesce("_digest", "digest")).drop("_id", "_digest")

    def single(self, rows: DataFrame) -> DataFrame:
        """One row (doc_id, digest, ...) an id."""
        return self.with_digest(rows).filter("own = digest").drop("own").dropDuplicates(["doc_id"]) if self.repeated else rows


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int, known: Ids) -> DataFrame:
    """doc_id, shingles (sorted hashes) of the documents with the given ids, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in batches:
            sets = [shingle_set(x.as_py(), words, hashes) for x in batch.column(1)]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array([np.sort(x.view(np.int64)) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "digest", "shingles"])

    texts = restrict(docs.select("doc_id", "text"), "doc_id", ids)
    return written(known.single(texts.mapInArrow(run, "doc_id bigint, digest binary, shingles array<bigint>")).drop("digest"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, known: Ids) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the similarity."""
    sets = shingle_sets(docs, endpoints(pairs), words, known)
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def blocks(open_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Members of open buckets with their facts (doc_id, ...), dealt to pairs of blocks (key, i, j).

    A bucket is cut into blocks of about BLOCK members, fewer if their texts are
    long, and each pair of blocks is a group of its own, so no task holds a
    whole large bucket.
    """
    rows = open_rows.join(facts, "doc_id")
    need = F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
    sizes = open_rows.join(facts.select("doc_id", "n_shingles"), "doc_id").groupBy("key").agg(F.ceil(need).cast("int").alias("g"))
    rows = rows.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("g")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("g", "other").groupBy("key", "i", "j")


class BlockPairs:
    """The plausible pairs of a pair of blocks whose members are in different components.

    A pair that shares several bands is looked at in the first of them only.
    """

    def __init__(self, group: pa.Table, threshold: float) -> None:
        self.ids, self.comps, self.sizes, mine = (group.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles", "mine"))
        self.comps, self.threshold = self.comps.copy(), threshold
        self.sig = signatures(group.column("sig"), len(group.column("sig")[0].as_py()) // 2)
        self.bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)
        self.band = int(np.flatnonzero(self.bands[0] == group.column("key")[0].as_py())[0])
        j = group.column("j")[0].as_py()
        self.left, self.right = np.flatnonzero(mine != j), np.flatnonzero(mine == j)
        self.own = not len(self.left)
        if self.own:
            self.left = self.right  # a block with itself

    def partners(self, x: int) -> np.ndarray:
        """The places of the plausible partners of the member at place x."""
        ys = self.right[self.comps[self.right] != self.comps[x]]
        if self.own:
            ys = ys[self.ids[ys] > self.ids[x]]
        ys = ys[np.minimum(self.sizes[ys], self.sizes[x]) >= np.maximum(self.sizes[ys], self.sizes[x]) * (self.threshold - 1e-9)]
        ys = ys[~(self.bands[ys, : self.band] == self.bands[x, : self.band]).any(axis=1)] if len(ys) else ys
        return ys[plausible(np.broadcast_to(self.sig[x], (len(ys), self.sig.shape[1])), self.sig[ys], self.threshold)] if len(ys) else ys

    def merge(self, x: int, y: int) -> None:
        self.comps[self.comps == self.comps[y]] = self.comps[x]


def cross_links(open_rows: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int, known: Ids) -> DataFrame:
    """Links (a, b) between members of one bucket in different components, confirmed on the full sets.

    Comparisons stay inside tasks: the first pass returns the documents that
    have any plausible partner, the second gets those documents' sets and
    returns true links only. So near copies that miss the threshold narrowly
    do not become a row a pair.
    """
    threshold = percent / 100
    ids = written(open_rows.select(F.col("doc_id").alias("id")).distinct(), "ids")
    facts = restrict(reps.select("doc_id", "n_shingles", "sig", "bands"), "doc_id", ids)

    def find(_, group):
        pairs, hit = BlockPairs(group, threshold), np.zeros(group.num_rows, bool)
        for x in pairs.left:
            if len(ys := pairs.partners(x)):
                hit[ys] = hit[x] = True
        return pa.table({"id": pa.array(pairs.ids[hit])})

    near = written(blocks(open_rows, facts).applyInArrow(find, "id bigint").distinct(), "near")
    sets = shingle_sets(docs, near, words, known)
    with_sets = restrict(facts, "doc_id", near).join(sets, "doc_id")

    def confirm(_, group):
        pairs, found = BlockPairs(group, threshold), []
        column = group.column("shingles").combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        for x in pairs.left:
            ys, mine = pairs.partners(x), flat[ends[x] : ends[x + 1]]
            if not len(ys) or not len(mine):
                continue
            for y in ys:
                if pairs.comps[y] == pairs.comps[x]:
                    continue  # linked in the meantime
                other = flat[ends[y] : ends[y + 1]]
                both = np.count_nonzero(mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other)
                if both * 100 >= (len(other) + len(mine) - both) * percent:
                    found.append((min(pairs.ids[x], pairs.ids[y]), max(pairs.ids[x], pairs.ids[y])))
                    pairs.merge(x, y)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    again = restrict(open_rows, "doc_id", near)
    return blocks(again, with_sets).applyInArrow(confirm, "a bigint, b bigint").distinct()


def placed_in(members: DataFrame, found: DataFrame) -> DataFrame:
    """key, doc_id, component of the members of buckets that are still in more than one component, as a written table."""
    placed = members.join(found, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("key")
    return written(placed.join(written(split, "keys"), "key", "left_semi"), "open")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    threshold = percent / 100
    sketches = sketch(docs, words)
    named = sketches.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    known = Ids(named)
    named = written(known.single(named), "named") if known.repeated else named
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    copies = named.select("doc_id", "digest").join(written(classes.filter("n > 1"), "repeated"), "digest").filter("doc_id <> rep").select(F.col("doc_id").alias("id"))
    reps = restrict(named, "doc_id", written(copies, "copies"), "left_anti")

    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("_last")).filter("center < _last").select("key", "center")
    members = written(keys.join(buckets, "key"), "members")
    links = None

    def grown(stars: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links with those of the stars (center, doc_id), and the components that they make."""
        pairs = stars.select(F.least("center", "doc_id").alias("a"), F.greatest("center", "doc_id").alias("b")).distinct()
        pairs = written(survivors(written(pairs, "pairs"), reps, threshold), "pairs")
        new = written(confirmed(pairs, docs, words, percent, known), "links")
        every = new if links is None else links.union(new)
        return every, written(components(every), "components")

    links, found = grown(members.filter("doc_id <> center").select("center", "doc_id"))
    members = members.select("key", "doc_id")
    open_rows = placed_in(members, found)
    for turn in range(1, STARS):
        if open_rows.isEmpty():
            break
        draw = F.struct(F.xxhash64("doc_id", F.lit(turn)), "doc_id", "component")
        centers = open_rows.groupBy("key").agg(F.min(draw).alias("c")).select("key", F.col("c.doc_id").alias("center"), F.col("c.component").alias("_own"))
        links, found = grown(open_rows.join(written(centers, "centers"), "key").filter("component <> _own").select("center", "doc_id"))
        open_rows = placed_in(open_rows.select("key", "doc_id"), found)

    more = written(cross_links(open_rows, reps, docs, words, percent, known), "links")
    if not more.isEmpty():
        found = written(components(links.union(more)), "components")

    linked = classes.join(found, F.col("rep") == F.col("node"), "left").select("digest", "n", "rep", F.coalesce("component", "rep").alias("class_id"))
    # A class of one that is linked with nothing is its own component, so it need not be joined.
    linked = written(linked.filter("n > 1 or class_id <> rep").select("digest", "class_id"), "classes")
    rows = sketches.select("doc_id", "n_shingles", "digest")
    alone = F.col("digest").isNull() | F.col("doc_id").isNull()
    out = known.with_digest(rows.filter(~alone)).join(linked, "digest", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("component_id"))
    if known.repeated:
        # A wordless row may share the id of one with words.
        ids = written(known.again.select("_id", "_digest").join(linked, F.col("_digest") == F.col("digest"), "left").select("_id", "class_id"), "again")
        rest = rows.filter(alone).join(broadcast_if_small(ids), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("component_id"))
    else:
        rest = rows.filter(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(rest)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all columns, without all but one of each group of near-duplicates.

    Only the ids that go are joined, and broadcast if few. Of rows that repeat
    an id and its text the one whose columns have the smallest hash stays.
    """
    found = written(near_duplicates(docs, words, percent), "components")
    gone = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    again = written(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("id")), "again")
    out = restrict(docs, "doc_id", gone, "left_anti")
    if again.isEmpty():
        return out
    same = restrict(out, "doc_id", again).select("doc_id", "text", hashed(docs).alias("_hash"), F.struct(*docs.columns).alias("_row"))
    same = same.groupBy("doc_id", "text").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*")
    return restrict(out, "doc_id", again, "left_anti").union(same)


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, similarity 0.8."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


QUERIES = {"op6_minhash_neardup": op6_minhash_neardup}
ORACLE_SQL = {
    # An exact similarity join over an inverted index of shingles; components by reachability.
    "op6_minhash_neardup": """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(ws) = 0 THEN []
            WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g
        FROM w
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), l AS (
        SELECT a.doc_id AS a, b.doc_id AS b
        FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
        JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, na.n, nb.n
        HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
    ), e AS (
        SELECT a, b FROM l UNION ALL SELECT b, a FROM l
    ), r(doc_id, node) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a
    ), c AS (
        SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
    """
}
