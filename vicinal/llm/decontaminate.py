"""Benchmark decontamination by latent semantic retrieval.

1. Inverse document frequencies of hashed words are counted over all documents.
2. Benchmark passages become TF-IDF rows. A randomised SVD by subspace
   iteration, distributed over the passages, gives an orthonormal basis of
   rank ``RANK`` of the words they share: a random block of vectors is
   multiplied by A'A again and again, task by task, and re-orthogonalised.
3. All documents are cut into overlapping windows at several scales. A window
   is folded into the latent space, and its cosine with each passage decides
   whether the pair is a candidate. What each word can bring to the cosine with
   any passage is known beforehand, and the sum over a window bounds its cosine,
   so most windows need no projection and none is lost by that.
   The basis holds only part of a passage once there are more passages than its
   rank. So every passage is looked for by its words as well: the weight of the
   words that it has in common with a window is never less than that of a common
   subsequence, and every window that reaches ``LIKELY`` is a candidate. No copy
   that lies within one and a half lengths of its passage is lost by this.
4. All candidates of a passage are checked on their words, windows of near
   cosine that overlap as one: the longest common subsequence of the passage
   and the document around the window, weighted by IDF, as a share of the
   passage. The region with the largest share counts. A share of ``SURE`` or
   more is a leak; a lower one from ``LIKELY`` on is a leak if the answer is
   there as well: the passage's answer, or where the table has none, its last
   sentence. Candidates are found by hashed words, confirmed by the words
   themselves.

Passages go through the documents in blocks of at most about ``BLOCK_ITEMS``
passages and ``BLOCK_WORDS`` words, so what is broadcast is bounded: a block
of passages, and a basis of at most ``BUCKETS * RANK`` numbers.

Words are lower-cased runs of characters other than white space and ASCII
punctuation.

Defined cases: null and wordless texts leak nothing; passages without words
are never found; a passage shorter than a window is compared as it is; one
of less than ``LEAST_WORDS`` words leaks where its words stand in a row, whole
and unchanged, and its three figures are 1; rows that repeat an id are one
document whose best match counts; repeated passages are all reported; an empty
benchmark gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.common import written
from vicinal.session import table

BUCKETS = 2**17
RANK, OVERSAMPLE, ITERATIONS = 256, 16, 2
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
#: The shortest window, or shorter for shorter passages, and by how much the next is longer; the longest holds the longest passage.
SHORTEST, LONGER = 16, 2
LEAST_COSINE = 0.5
SURE, LIKELY = 0.8, 0.5
ANSWER = 0.8
#: The share of a passage's weight, in its lightest words, that is taken as given when its words are looked for.
LIGHT = 0.2
#: A document is searched by words in stretches of so many, and so many sums of passages by windows at once.
STRETCH, SUMS = 4096, 2**21
#: Passages of fewer words are found where all of them stand in a row, and only there.
LEAST_WORDS = 5
_SPACES = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A text's words, in order."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split() if text else []


def buckets_of(words: list[bytes]) -> np.ndarray:
    """The buckets of words, in order."""
    return np.fromiter(map(crc32, words), np.int64, len(words)) & (BUCKETS - 1)


def word_buckets(text: str | None) -> np.ndarray:
    """The buckets of a text's words, in order."""
    return buckets_of(words_of(text))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the word)) for each bucket, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                counts[np.unique(word_buckets(text.as_py()))] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([rows, *counts[at]], pa.int64())], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    total = n[at < 0].sum()
    counts = np.zeros(BUCKETS)
    counts[at[at >= 0]] = n[at >= 0]
    return np.log((total + 1) / (counts + 1)).astype(np.float32) + np.float32(1e-3)


def tf_idf(words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a unit TF-IDF row."""
    cols, tf = np.unique(words, return_counts=True)
    vals = tf * weights[cols]
    return cols, vals / np.linalg.norm(vals)


PASSAGES = "item_id bigint, words array<binary>, answer array<binary>, cols array<bigint>, vals array<double>"


def passages(benchmark: DataFrame, idf) -> DataFrame:
    """item_id, words, answer, cols, vals: words in order and the unit TF-IDF row of each passage, as a written table.

    A passage of less than ``LEAST_WORDS`` words has an empty row.

    idf: a broadcast variable.
    """
    answers = "answer" in benchmark.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in batches:
            rows = []
            for i, (item, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = words_of(text)
                if not words:
                    continue
                sentences = [s for s in (text or "").replace("\n", " ").split(". ") if s.strip()]
                answer = words_of(batch.column(2)[i].as_py() if answers else sentences[-1])
                rows.append((item, words, answer, *(([], []) if len(words) < LEAST_WORDS else tf_idf(buckets_of(words), weights))))
            if rows:
                kinds = [pa.int64(), *[pa.list_(pa.binary())] * 2, pa.list_(pa.int64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item_id", "words", "answer", "cols", "vals"])

    columns = ["item_id", "text", *(["answer"] if answers else [])]
    out = benchmark.filter(F.col("item_id").isNotNull()).select(*columns)
    return written(out.mapInArrow(run, PASSAGES), "passages")


def gram_product(rows: DataFrame, used: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A'A times a block of vectors, where A has the TF-IDF rows and the columns ``used``.

    A task sends the rows of the product that its passages touch; they are
    added up by row, dealt over all tasks.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((used, block))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, block = shared.value
        out, touched = np.zeros(block.shape, np.float32), np.zeros(len(used), bool)
        for batch in batches:
            for cols, vals in zip(batch.column(0), batch.column(1), strict=True):
                at, x = np.searchsorted(used, cols.values.to_numpy()), vals.values.to_numpy().astype(np.float32)
                out[at] += np.outer(x, x @ block[at])
                touched[at] = True
        touched = np.flatnonzero(touched)
        for at in range(0, len(touched), 1024):
            own = touched[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(out[own]), pa.list_(pa.float32()))], names=["row", "vector"])

    def add(_, group):
        row, vectors = group.column("row").to_numpy(), group.column("vector").combine_chunks().flatten().to_numpy()
        found, place = np.unique(row, return_inverse=True)
        total = np.zeros((len(found), len(vectors) // len(row)))
        np.add.at(total, place, vectors.reshape(len(row), -1))
        return pa.table({"row": pa.array(found, pa.int64()), "vector": pa.array(list(total.astype(np.float32)), pa.list_(pa.float32()))})

    parts = rows.filter("size(cols) > 0").select("cols", "vals").mapInArrow(multiply, "row bigint, vector array<float>")
    found = parts.groupBy(F.floor(F.col("row") / 256).alias("part")).applyInArrow(add, "row bigint, vector array<float>").toArrow()
    shared.unpersist()
    out = np.zeros(block.shape, np.float32)
    if found.num_rows:
        out[found.column("row").to_numpy()] = found.column("vector").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    return out


def orthonormal(block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns' space, by the eigenvectors of their small Gram matrix, taken twice for accuracy."""
    for _ in range(2):
        gram = sum((part.T @ part for part in (block[at : at + 8192].astype(np.float64) for at in range(0, len(block), 8192))), np.zeros((block.shape[1],) * 2))
        values, turn = np.linalg.eigh(gram)
        kept = values > 1e-10 * values.max()
        block = block @ (turn[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    return block


def latent_basis(rows: DataFrame, rank: int = RANK, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets used and, for each, its row of the right singular vectors."""
    used = np.sort(rows.select(F.explode("cols").alias("c")).distinct().toArrow().column("c").to_numpy())
    count = rows.filter("size(cols) > 0").count()
    if not count:
        return used, np.zeros((0, 0), np.float32)
    width = min(rank + OVERSAMPLE, len(used))
    q = orthonormal(np.random.default_rng(7).standard_normal((len(used), width), np.float32))
    for _ in range(iterations):
        q = orthonormal(gram_product(rows, used, q))
    values, turn = np.linalg.eigh(q.T.astype(np.float64) @ gram_product(rows, used, q))
    order = np.argsort(-values)[: min(rank, count)]
    order = order[values[order] > 1e-9 * values.max()]
    return used, q @ turn[:, order].astype(np.float32)


def weighted_lcs(item: np.ndarray, region: np.ndarray, weights: np.ndarray) -> float:
    """The largest weight of a common subsequence of two sequences of word numbers."""
    best = np.zeros(len(region) + 1)
    for word in item:
        same = region == word
        if same.any():
            # A match extends the best of everything before it; the running maximum carries it on.
            best[1:] = np.maximum.accumulate(np.where(same, best[:-1] + weights[word], best[1:]))
    return float(best[-1])


class Phrases:
    """Passages too short for a cosine, found word by word in a row."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]) -> None:
        self.phrases: dict[int, tuple[np.ndarray, dict[bytes, list[int]]]] = {}
        for n in sorted({len(words) for _, words in passages}):
            of: dict[bytes, list[int]] = {}
            for number, words in passages:
                if len(words) == n:
                    of.setdefault(b" ".join(words), []).append(number)
            self.phrases[n] = np.unique(np.concatenate([self.keys(buckets_of(x.split()), n) for x in of])), of

    @staticmethod
    def keys(words: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of n words."""
        out = words[: len(words) - n + 1].astype(np.uint64)
        for k in range(1, n):
            out = out * np.uint64(BUCKETS + 29) + words[k : len(words) - n + 1 + k].astype(np.uint64)
        return out

    def found(self, said: list[bytes], words: np.ndarray) -> Iterator[int]:
        """The numbers of the passages that a text's words hold."""
        for n, (keys, of) in self.phrases.items():
            at = np.flatnonzero(np.isin(self.keys(words, n), keys)) if len(words) >= n else ()
            if len(at):
                for phrase in {b" ".join(said[k : k + n]) for k in at.tolist()} & of.keys():
                    yield from of[phrase]


class Overlap:
    """The words of passages of up to ``length`` words, to find windows of twice the length that may hold one.

    The lightest words, of ``LIGHT`` of a passage's weight, are taken as given;
    the others must bring what is missing to ``LIKELY``. A repeated word counts
    again, so the sums are upper bounds of the weight in common.
    """

    def __init__(self, length: int, numbers: list[int], buckets: list[np.ndarray], idf: np.ndarray) -> None:
        self.length, self.numbers = length, np.array(numbers)
        words, of, gains = [], [], []
        for k, number in enumerate(numbers):
            found, times = np.unique(buckets[number], return_counts=True)
            order = np.argsort(idf[found], kind="stable")
            held = np.cumsum((times * idf[found].astype(np.float64))[order])
            first = int(np.searchsorted(held, LIGHT * held[-1], side="right"))
            given = held[first - 1] if first else 0.0
            heavy = found[order[first:]]
            words.append(heavy)
            of.append(np.full(len(heavy), k))
            gains.append(idf[heavy] / (LIKELY * held[-1] - given))
        word, of, gains = np.concatenate(words), np.concatenate(of), np.concatenate(gains)
        order = np.argsort(word, kind="stable")
        self.of, self.gains = of[order].astype(np.int32), gains[order]
        self.times = np.bincount(word, minlength=BUCKETS).astype(np.int32)
        self.start = np.cumsum(self.times) - self.times

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Passage number, first and end word of each window that may hold the passage."""
        step = self.length // 2
        for base in range(0, len(words), STRETCH // step * step or step):
            part = words[base : base + (STRETCH // step * step or step) + 3 * step]
            times = self.times[part]
            at = np.flatnonzero(times)
            times = times[at]
            ends = np.cumsum(times)
            if not len(at):
                continue
            hits = np.repeat(self.start[part[at]] - ends + times, times) + np.arange(ends[-1])
            of, gains = self.of[hits], self.gains[hits]
            alive = np.bincount(of, gains, len(self.numbers)) >= 1 - 1e-6
            if not alive.any():
                continue
            kept = alive[of]
            place = (np.cumsum(alive) - 1)[of[kept]]
            steps, gains = np.repeat(at // step, times)[kept], gains[kept]
            count, width = int(alive.sum()), len(part) // step + 4
            numbers, group = self.numbers[alive], max(1, SUMS // width)
            for g in range(0, count, group):
                here = slice(None) if count <= group else (place >= g) & (place < g + group)
                rows = min(group, count - g)
                sums = np.bincount((place[here] - g) * width + steps[here], gains[here], rows * width).reshape(rows, width)
                sums = sums[:, :-3] + sums[:, 1:-2] + sums[:, 2:-1] + sums[:, 3:]
                for k, first in zip(*(x.tolist() for x in np.nonzero(sums >= 1 - 1e-6)), strict=True):
                    yield int(numbers[g + k]), base + first * step, min(base + first * step + 2 * self.length, len(words))


class Index:
    """A block of passages in latent space and by words, with what a task needs to search a document.

    items: item_id, words, answer, cols, vals of each passage.
    """

    def __init__(self, idf: np.ndarray, used: np.ndarray, basis: np.ndarray, items: list[tuple]) -> None:
        self.idf, self.squared, self.basis = idf, idf.astype(np.float64) ** 2, basis
        self.row = np.full(BUCKETS, -1, np.int32)
        self.row[used] = np.arange(len(used), dtype=np.int32)
        self.ids, self.rows = [x[0] for x in items], [x[3:5] for x in items]
        self.buckets = [buckets_of(x[1]) for x in items]
        #: The passages' words by number, to confirm what the buckets suggest.
        self.number = {word: i for i, word in enumerate(dict.fromkeys(word for x in items for word in (*x[1], *x[2])))}
        self.weights = idf[buckets_of(list(self.number))]
        self.words, self.answers = ([np.array([self.number[word] for word in x[k]], np.int64) for x in items] for k in (1, 2))
        lengths: dict[int, list[int]] = {}
        for number, x in enumerate(items):
            if len(x[1]) >= LEAST_WORDS:
                lengths.setdefault(1 << max(2, (len(x[1]) - 1).bit_length()), []).append(number)
        self.phrases = Phrases([(number, x[1]) for number, x in enumerate(items) if len(x[1]) < LEAST_WORDS])
        self.scales = [SHORTEST]
        while lengths and self.scales[0] >= 2 * min(len(items[k][1]) for k in lengths[min(lengths)]):
            self.scales[0] //= 2
        while self.scales[-1] < max(len(x[1]) for x in items):
            self.scales.append(self.scales[-1] * LONGER)
        latent = np.array([x[4] @ basis[self.row[x[3]]] for x in items], np.float32).reshape(len(items), basis.shape[1])
        norms = np.linalg.norm(latent, axis=1, keepdims=True)
        self.latent = latent / np.maximum(norms, 1e-9)
        #: The most that one occurrence of a bucket's word adds to the dot product with any passage.
        self.gain = np.zeros(BUCKETS)
        for at in range(0, len(used) if basis.size else 0, 1024):
            own = used[at : at + 1024]
            self.gain[own] = idf[own] * np.maximum((basis[at : at + 1024] @ self.latent.T).max(axis=1), 0)
        self.overlaps = [Overlap(length, numbers, self.buckets, idf) for length, numbers in sorted(lengths.items())]
        self.counts = [np.unique(x, return_counts=True) for x in self.buckets]

    def fold(self, weight: np.ndarray, row: np.ndarray, near: np.ndarray, step: int) -> np.ndarray:
        """The latent vectors of windows of four steps, the first of which are ``near``.

        Words that windows share are looked up once: a small matrix of words by
        windows meets the basis of the words in one product.
        """
        steps = np.unique(near[:, None] + np.arange(4))
        at = (steps[:, None] * step + np.arange(step)).ravel()
        at = at[at < len(row)]
        at = at[row[at] >= 0]
        used, place = np.unique(row[at], return_inverse=True)
        sums = np.bincount(np.searchsorted(steps, at // step) * len(used) + place, weight[at], len(steps) * len(used)).reshape(len(steps), len(used))
        first = np.searchsorted(steps, near)
        return (sums[first] + sums[first + 1] + sums[first + 2] + sums[first + 3]).astype(np.float32) @ self.basis[used]

    def candidates(self, words: np.ndarray) -> dict[int, list[tuple[float | None, int, int]]]:
        """Passage number -> (cosine, first, end word) of the regions that may hold it; no cosine where words alone found it."""
        out: dict[int, list[tuple[float | None, int, int]]] = {}
        for number, windows in self.latent_windows(words).items():
            reach, at = len(self.buckets[number]), 0
            regions = out.setdefault(number, [])
            for cosine, first, end in sorted(windows, key=lambda x: x[1]):
                if regions and first < at:
                    cosine, begin, at = max(cosine, regions[-1][0]), regions[-1][1], max(at, end)
                    regions.pop()
                else:
                    begin, at = max(0, first - reach), end
                regions.append((cosine, begin, min(at + reach, len(words))))
        for overlap in self.overlaps:
            for number, first, end in overlap.windows(words):
                out.setdefault(number, []).append((None, first, end))
        return out

    def latent_windows(self, words: np.ndarray) -> dict[int, list[tuple[float, int, int]]]:
        """Passage number -> (cosine, first, end word) of every window near it."""
        weight, row = self.idf[words], self.row[words]
        mass, gain = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
        np.cumsum(self.squared[words], out=mass[1:])
        np.cumsum(self.gain[words], out=gain[1:])
        out: dict[int, list[tuple[float, int, int]]] = {}
        for scale in self.scales:
            first = np.arange(0, max(len(words) - scale, 0) + scale // 4, scale // 4)
            first = first[first < len(words)]
            end = np.minimum(first + scale, len(words))
            total = mass[end] - mass[first]
            # No dot product is above the sum of what its words can bring.
            near = np.flatnonzero(gain[end] - gain[first] >= 0.999 * LEAST_COSINE * np.sqrt(total))
            if not len(near):
                if scale >= len(words):
                    break
                continue
            for c in range(0, len(near), 128):
                chunk = near[c : c + 128]
                # A norm that counts each occurrence by itself is never above the TF-IDF norm: no window is lost here.
                dot = self.fold(weight, row, chunk, scale // 4) @ self.latent.T
                close = dot >= LEAST_COSINE * np.sqrt(total[chunk])[:, None]
                for k in np.flatnonzero(close.any(axis=1)):
                    at = slice(first[chunk[k]], end[chunk[k]])
                    cosine = dot[k] / np.linalg.norm(np.bincount(np.unique(words[at], return_inverse=True)[1], weight[at]))
                    for item in np.flatnonzero(cosine >= LEAST_COSINE).tolist():
                        out.setdefault(item, []).append((min(1.0, float(cosine[item])), int(at.start), int(at.stop)))
            if scale >= len(words):
                break
        return out

    def cosine(self, number: int, window: np.ndarray) -> float:
        """The TF-IDF cosine of a window and a passage."""
        found, times = np.unique(window, return_counts=True)
        vals = times * self.idf[found].astype(np.float64)
        cols, row = self.rows[number]
        _, a, b = np.intersect1d(found, cols, assume_unique=True, return_indices=True)
        return float(vals[a] @ row[b] / np.linalg.norm(vals))

    def common(self, number: int, region: np.ndarray) -> float:
        """The weight of the words in common, each as often as both have it: no common subsequence weighs more."""
        found, times = self.counts[number]
        at = np.minimum(np.searchsorted(found, region), len(found) - 1)
        return float(np.minimum(np.bincount(at[found[at] == region], minlength=len(found)), times) @ self.idf[found])

    def checked(self, number: int, said: list[bytes], words: np.ndarray, regions: list[tuple[float | None, int, int]]) -> tuple[float, float, float] | None:
        """Cosine, subsequence share and answer share of the region that leaks most of a passage; None if none leaks."""
        item, answer = self.words[number], self.answers[number]
        weight, best = float(self.weights[item].sum()), None
        bounds = [self.common(number, words[first:end]) / weight for _, first, end in regions]
        for k in np.argsort(-np.array(bounds), kind="stable"):
            if bounds[k] < LIKELY - 1e-6 or (best and best[1] >= bounds[k] - 1e-6):
                break
            cosine, first, end = regions[k]
            region = np.fromiter((self.number.get(word, -1) for word in said[first:end]), np.int64, end - first)
            share = weighted_lcs(item, region[np.isin(region, item)], self.weights) / weight
            if share < LIKELY or (best and share <= best[1]):
                continue
            found = weighted_lcs(answer, region, self.weights) / float(self.weights[answer].sum()) if len(answer) else 1.0
            if share >= SURE or found >= ANSWER:
                best = self.cosine(number, words[first:end]) if cosine is None else cosine, share, found
        return best

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item_id, cosine, subsequence share, answer share) of the passages that the text leaks."""
        said = words_of(text)
        if not said:
            return []
        words = buckets_of(said)
        found = ((number, self.checked(number, said, words, regions)) for number, regions in self.candidates(words).items())
        out = [(self.ids[number], *leak) for number, leak in found if leak]
        return out + [(self.ids[number], 1.0, 1.0, 1.0) for number in self.phrases.found(said, words)]


LEAK_SCHEMA = "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_share double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of every leak of ``benchmark`` (item_id, text) in ``docs``."""
    spark = docs.sparkSession
    idf = inverse_frequencies(docs)
    rows = passages(benchmark, spark.sparkContext.broadcast(idf))
    count, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], LEAK_SCHEMA)
    used, basis = latent_basis(rows, rank)
    blocks = max(-(-count // BLOCK_ITEMS), -(-words // BLOCK_WORDS))
    out = None
    for block in range(blocks):
        of = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        if not of.num_rows:
            continue
        items = [(i, words, answer, np.array(cols, np.int64), np.array(vals, float)) for i, words, answer, cols, vals in zip(*[c.to_pylist() for c in of.columns], strict=True)]
        shared = spark.sparkContext.broadcast(Index(idf, used, basis, items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in index.leaks(text.as_py())]
                if found:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        part = docs.select("doc_id", "text").mapInArrow(run, LEAK_SCHEMA)
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share")))


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of all benchmark passages in all documents."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("cosine", "lcs_share", "answer_share")))


QUERIES = {"op7_latent_decontamination": op7_latent_decontamination}
ORACLE_SQL: dict[str, str] = {}
