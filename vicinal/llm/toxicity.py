"""Toxicity scores from a learnt lexicon, Levenshtein automata and context windows.

Lexicon. From labelled rows, terms are learnt that occur in toxic texts far
more often than chance allows: whole words and stems (prefixes). Near copies
(texts that share a band of MinHash values) with the same label count once, so
that a group of copies does not fill the lexicon with its ordinary words. A term
enters if the binomial tail of its toxic share, times the number of terms
tested, is below ``SIGNIFICANCE`` and it is mostly toxic; of more than
``MOST_TERMS`` words or stems, the most significant stay.

Matching. The lexicon is a trie. A word is matched by a Levenshtein automaton
(the set of positions and errors that are still possible) run along the
trie's edges, so all entries within the allowed distance are found in one
descent that leaves a branch as soon as the automaton dies. Entries of fewer
than 5 letters must match exactly, longer ones allow one edit and those of
``TWO_EDITS`` letters two. By the pigeonhole principle a word within k edits
of an entry has one of the entry's k + 1 pieces unchanged, so only words with
such a piece are looked up; pieces are found in whole texts by a multi-pattern
search. Answers for words are remembered up to a bound.

Context. A window around each hit separates quotation from abuse. Its words,
and whether the hit stands inside quotation marks, are tokens whose log-odds
are learnt from the hits of labelled rows: a token that goes with hits in clean
texts more than others do speaks for quotation. Their sum gives the hit's share
of abuse, by which its weight is divided between abuse and quotation. Until
labels say otherwise, quotation marks count against abuse and words for nothing.
A logistic regression over the divided log-odds, exact and misspelt, gives the
score. Its prior holds quoted hits at half the weight of others.

Learning uses at most about ``FIT_ROWS`` labelled rows, chosen by a hash of the
id; every text is scored whole.

Defined cases: null and empty texts have no hits and get the score of a text
without hits; without any usable label the score is 0; several labels of one
document count as toxic if one of them is; a label without a document and null
labels are ignored. Rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.common import broadcast_if_small, held_out, written
from vicinal.llm.neardup import _multipliers, _WordHash, band_keys, minhashes, shingle_set
from vicinal.session import table

#: About so many labelled rows are learnt from.
FIT_ROWS = 60_000
#: At most so many words and so many stems, and so many context tokens, the most significant.
MOST_TERMS, MOST_TOKENS = 5_000, 5_000
#: Bands of MinHash values over shingles of so many words, by which near copies among labelled texts count once.
BANDS, ROWS, SHINGLE = 20, 4, 3
SIGNIFICANCE = 0.01
LEAST_PURITY = 0.8
STEMS = (4, 5, 6, 7, 8)
ONE_EDIT, TWO_EDITS = 5, 9
WORD_CACHE = 500_000
#: Characters looked at on each side of a hit.
CONTEXT = 80
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’", "‹": "›"}
#: The token of a hit inside quotation marks, and the clean and toxic hits that it is taken to have had before any label.
QUOTED, QUOTED_BEFORE = "\x22", (2.0, 0.5)
#: Hits that any token is taken to have had, at the overall share; the most that a context may say.
TOKEN_BEFORE, MOST_SAID = 4.0, 3.0

_WORD = re.compile(r"[^\W_]+")


class Automaton:
    """A Levenshtein automaton of a word: states are sets of (position, errors)."""

    def __init__(self, word: str, edits: int) -> None:
        self.word, self.edits = word, edits

    def start(self) -> tuple[tuple[int, int], ...]:
        return self._closed({(0, 0)})

    def _closed(self, state: set[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
        """With the moves that leave out letters of the word; only the fewest errors of a position are kept."""
        best: dict[int, int] = {}
        for i, e in state:
            for k in range(self.edits - e + 1):
                if i + k <= len(self.word) and best.get(i + k, self.edits + 1) > e + k:
                    best[i + k] = e + k
        return tuple(sorted(best.items()))

    def step(self, state: tuple[tuple[int, int], ...], letter: str) -> tuple[tuple[int, int], ...]:
        """The state after a letter of the entry; empty when no entry below can match."""
        out = set()
        for i, e in state:
            if i < len(self.word) and self.word[i] == letter:
                out.add((i + 1, e))
            if e < self.edits:
                out.add((i, e + 1))
                if i < len(self.word):
                    out.add((i + 1, e + 1))
        return self._closed(out)

    def errors(self, state: tuple[tuple[int, int], ...]) -> int | None:
        """Edits to the whole word, None where it is out of reach."""
        return next((e for i, e in state if i == len(self.word)), None)

    def prefix_errors(self, state: tuple[tuple[int, int], ...]) -> int | None:
        """Edits to a prefix of the word."""
        return min((e for _, e in state), default=None)


class Lexicon:
    """Terms with log-odds in a trie; stems match words that begin with them."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.root: dict = {}
        for terms, slot in ((words, 0), (stems, 1)):
            for term, weight in terms.items():
                node = self.root
                for c in term:
                    node = node.setdefault(c, {})
                node[slot] = (weight, self.allowed(term))
        self.words, self.stems, self.known = words, stems, {}
        pieces = set()
        for term in (*words, *stems):
            k = self.allowed(term) + 1
            cuts = [len(term) * i // k for i in range(k + 1)]
            pieces.update(term[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        self.pieces = sorted(pieces)

    @staticmethod
    def allowed(term: str) -> int:
        return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0

    def match(self, word: str) -> tuple[float, int] | None:
        """(log-odds, edits) of the entry with the fewest edits, then the largest log-odds."""
        if word in self.known:
            return self.known[word]
        automaton, best = Automaton(word, 2), None
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            for slot, errors in ((0, automaton.errors(state)), (1, automaton.prefix_errors(state))):
                if errors is not None and (entry := node.get(slot)) and errors <= entry[1] and (best is None or (errors, -entry[0]) < (best[1], -best[0])):
                    best = entry[0], errors
            for letter, below in node.items():
                if isinstance(letter, str) and (after := automaton.step(state, letter)):
                    stack.append((below, after))
        if len(self.known) >= WORD_CACHE:
            self.known.clear()
        self.known[word] = best
        return best

    def searcher(self):
        """A multi-pattern search for the pieces, made once a task."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for piece in self.pieces:
            out.add_word(piece, len(piece))
        out.make_automaton()
        return out


def hits(text: str, lexicon: Lexicon, searcher) -> list[tuple[int, int, float, int]]:
    """(start, end, log-odds, edits) of each word of a lower-case text that the lexicon matches."""
    out, done = [], -1
    for last, length in searcher.iter(text):
        start = last - length + 1
        if start < done:
            continue  # in a word that was looked up
        while start > 0 and text[start - 1].isalnum():
            start -= 1
        end, n = last + 1, len(text)
        while end < n and text[end].isalnum():
            end += 1
        done = end
        if found := lexicon.match(text[start:end]):
            out.append((start, end, *found))
    return out


def quoted(before: str, after: str) -> bool:
    """Whether a hit between the two stretches of its line stands inside quotation marks."""
    for opening, closing in QUOTES.items():
        if opening == closing:
            if before.count(opening) % 2 and closing in after:
                return True
        elif before.rfind(opening) > before.rfind(closing) and closing in after:
            return True
    return False


def context(text: str, start: int, end: int) -> set[str]:
    """The tokens of the window around a hit: whole words of its line, and ``QUOTED``."""
    before, after = text[max(0, start - CONTEXT) : start].rpartition("\n")[2], text[end : end + CONTEXT].partition("\n")[0]
    words = {*_WORD.findall(before.partition(" ")[2] if start > CONTEXT else before), *_WORD.findall(after.rpartition(" ")[0] if end + CONTEXT < len(text) else after)}
    return words | {QUOTED} if quoted(before, after) else words


FEATURES = ("plain", "misspelt", "in_quotes", "density")


def features(text: str | None, lexicon: Lexicon, tokens: dict[str, float], searcher) -> list[float]:
    """What the regression sees of a text."""
    low = (text or "").lower()
    plain = misspelt = aside = 0.0
    for start, end, weight, edits in hits(low, lexicon, searcher) if lexicon.pieces else []:
        said = sum(tokens.get(t, 0.0) for t in context(low, start, end))
        # A context that says nothing leaves the whole weight with abuse.
        abuse = min(1.0, 2 / (1 + math.exp(-max(-MOST_SAID, min(MOST_SAID, said)))))
        if edits:
            misspelt += weight * abuse
        else:
            plain += weight * abuse
        aside += weight * (1 - abuse)
    return [math.log1p(plain), math.log1p(misspelt), math.log1p(aside), 100 * (plain + misspelt + aside) / (len(low) + 100)]


def divergence(n: Column, k: Column, p: float) -> Column:
    """n times the Kullback-Leibler divergence of k / n from p: minus the Chernoff bound of log P(a share as far off)."""
    q = k / n
    part = lambda x, of: F.when(x == 0, 0.0).otherwise(x * F.log(x / F.lit(of)))
    return n * (part(q, p) + part(1 - q, 1 - p))


def one_of_near_copies(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, toxic) without those that share a band of MinHash values with a row of the same label and a smaller id.

    The bands are of ``SHINGLE`` words, so that unrelated texts stay apart,
    however many there are. At a similarity of 0.57 (a text and its copy with one
    word in ten replaced) 89 of 100 pairs share a band, at 0.14 less than one. Of
    400 such copies about 40 stay. A shared band is not confirmed: of 2000
    texts with 60 words of their own and a passage that all share, 1531 stay if
    it has 25 words, 363 if it has 60 and 54 if it has 90.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = _WordHash(), _multipliers(BANDS * ROWS)
        for batch in batches:
            keys = [band_keys(minhashes(shingle_set(text.as_py(), SHINGLE, hashes), factors), BANDS, ROWS) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text", "toxic", "keys"])

    rows = rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id bigint, text string, toxic int, keys array<bigint>")
    rows = written(rows.withColumn("row", F.struct("doc_id", F.monotonically_increasing_id().alias("at"))), "toxic-sample")
    first = rows.select(F.explode("keys").alias("key"), "toxic", "row").groupBy("key", "toxic").agg(F.min("row").alias("row"))
    # A row that is the first of all its bands; narrow rows, as many as are learnt from at most.
    kept = written(first.groupBy("row").count().filter(F.col("count") == BANDS).select(F.col("row.at").alias("_at")), "toxic-rows")
    return rows.join(broadcast_if_small(kept), F.col("row.at") == F.col("_at"), "left_semi").select("text", "toxic")


def counted(rows: DataFrame, keys_of, schema: str) -> DataFrame:
    """n and toxic of every key (columns of ``schema``) that ``keys_of(text)`` gives of rows (text, toxic), as a written table.

    Each task adds up its own rows first, in tables of bounded size.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.split()[1] == "int" else pa.string() for x in schema.split(", ")]

    def out(found: dict[tuple, list[int]]) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1))], names=[*names, "n", "toxic"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for key in keys_of(text.as_py()):
                    n = found.setdefault(key, [0, 0])
                    n[0] += 1
                    n[1] += toxic
                if len(found) > 1_000_000:
                    yield out(found)
                    found = {}
        if found:
            yield out(found)

    parts = rows.select("text", "toxic").mapInArrow(count, f"{schema}, n bigint, toxic bigint")
    return written(parts.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "counts")


def terms_of(text: str | None) -> set[tuple[int, str]]:
    """The words (0, word) and stems (length, stem) of a text."""
    words = {w for w in _WORD.findall((text or "").lower()) if 3 <= len(w) <= 40}
    return {(0, w) for w in words} | {(k, w[:k]) for w in words for k in STEMS if len(w) > k}


def learn_lexicon(counts: DataFrame, texts: int, toxic: int, most: int = MOST_TERMS) -> Lexicon:
    """Significant, mostly toxic terms; a term that a stem covers as well is left out."""
    base, tested = toxic / texts, max(1, counts.filter("n >= 3").count())
    surplus = divergence(F.col("n"), F.col("toxic"), base)
    some = counts.filter((F.col("toxic") >= 3) & (F.col("toxic") >= LEAST_PURITY * F.col("n")) & (F.col("toxic") > F.lit(base) * F.col("n"))).withColumn("surplus", surplus)
    # In order of significance; a word and its stems are at most six terms.
    rows = some.filter(F.col("surplus") >= math.log(tested / SIGNIFICANCE)).orderBy(F.desc("surplus"), "kind", "term").limit(6 * most).collect()
    weight = {(r["kind"], r["term"]): math.log((r["toxic"] + 0.5) / (r["n"] - r["toxic"] + 0.5) * (1 - base) / base) for r in rows}
    # A stem that nearly always comes from one word is that word.
    of_one: dict[str, int] = {}
    for r in rows:
        if not r["kind"]:
            for k in STEMS:
                of_one[r["term"][:k]] = max(of_one.get(r["term"][:k], 0), r["toxic"])
    stems: dict[str, float] = {}
    for r in sorted((r for r in rows if r["kind"] and of_one.get(r["term"], 0) < 0.9 * r["toxic"]), key=lambda r: r["kind"]):
        if not any(stems.get(r["term"][:k], 0) >= weight[r["kind"], r["term"]] - 1 for k in range(1, r["kind"])):
            stems[r["term"]] = weight[r["kind"], r["term"]]
    stems = dict([(r["term"], stems[r["term"]]) for r in rows if r["kind"] and r["term"] in stems][:most])
    words = [(r["term"], weight[0, r["term"]]) for r in rows if not r["kind"]]
    return Lexicon(dict([x for x in words if not any(stems.get(x[0][:k], 0) >= x[1] - 1 for k in STEMS if k < len(x[0]))][:most]), stems)


def learn_context(rows: DataFrame, lexicon: Lexicon, most: int = MOST_TOKENS) -> dict[str, float]:
    """Log-odds of abuse of the tokens around hits, against those of all hits: of ``QUOTED`` always, of words that are significant."""

    class Tokens:
        """Made in each task: the search does not travel."""

        def __init__(self) -> None:
            self.search = None

        def __call__(self, text: str | None) -> list[tuple[str]]:
            self.search, low = self.search or lexicon.searcher(), (text or "").lower()
            return [(t,) for start, end, _, _ in hits(low, lexicon, self.search) for t in (*context(low, start, end), "")]

    if not lexicon.pieces:
        return {}
    counts = counted(rows, Tokens(), "token string")  # "" counts all hits
    own = {r["token"]: (r["n"], r["toxic"]) for r in counts.filter(F.col("token").isin("", QUOTED)).collect()}
    n, toxic = own.get("", (0, 0))
    base = (toxic + 0.5) / (n + 1)
    odds = lambda n, k, clean, bad: max(-MOST_SAID, min(MOST_SAID, math.log((k + bad) / (n - k + clean) * (1 - base) / base)))
    out = {QUOTED: odds(*own.get(QUOTED, (0, 0)), *QUOTED_BEFORE)}
    others = counts.filter(~F.col("token").isin("", QUOTED) & (F.col("n") >= 3)).withColumn("surplus", divergence(F.col("n"), F.col("toxic"), base))
    found = others.filter(F.col("surplus") >= math.log(max(1, others.count()) / SIGNIFICANCE)).orderBy(F.desc("surplus"), "token").limit(most).collect()
    return out | {r["token"]: odds(r["n"], r["toxic"], TOKEN_BEFORE * (1 - base), TOKEN_BEFORE * base) for r in found}


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and bias by Newton's method, with a Gaussian prior around ``prior``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pull = prior.astype(float).copy(), np.array([strength] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """Lexicon, context and weights; scores texts."""

    def __init__(self, lexicon: Lexicon, tokens: dict[str, float], weights: np.ndarray | None) -> None:
        self.lexicon, self.tokens, self.weights = lexicon, tokens, weights

    def scores(self, texts: list[str | None], searcher) -> np.ndarray:
        if self.weights is None or not texts:
            return np.zeros(len(texts))
        x = np.array([features(t, self.lexicon, self.tokens, searcher) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


#: Prior weights of the features and the bias.
PRIOR = np.array([2.0, 1.0, 1.0, 0.0, -3.0])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    """Learn from labelled rows of ``docs`` (doc_id, text) that are not held out."""
    labels = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    labels = labels.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("fit")), 11).cast("double") * F.lit(2.0**-53)
    labels = written(labels.filter(share * F.lit(labels.count()) < fit_rows), "labels")
    rows = one_of_near_copies(docs.select("doc_id", "text").join(broadcast_if_small(labels), "doc_id"))
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not toxic or toxic == n:
        return Scorer(Lexicon({}, {}), {}, None)
    lexicon = learn_lexicon(counted(rows, terms_of, "kind int, term string"), n, toxic)
    tokens = learn_context(rows, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = lexicon.searcher() if lexicon.pieces else None
        for batch in batches:
            x = np.array([features(t.as_py(), lexicon, tokens, searcher) for t in batch.column(0)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], names=[*FEATURES, "toxic"])

    seen = rows.mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", toxic int").toArrow()
    x = np.column_stack([seen.column(f).to_numpy() for f in FEATURES])
    return Scorer(lexicon, tokens, fit_logistic(x, seen.column("toxic").to_numpy().astype(float), PRIOR))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        searcher = scorer.lexicon.searcher() if scorer.lexicon.pieces else None
        for batch in batches:
            found = scorer.scores([x.as_py() for x in batch.column(1)], searcher)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
