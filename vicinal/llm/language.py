"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of bytes up to ``ORDER`` bytes deep whose
counts are learnt once and then frozen. A symbol's probability in a context
is count / (total + distinct); where the context has not seen it, the escape
probability distinct / (total + distinct) is paid and the next shorter context
tried, down to a uniform order -1 (escape method C, no exclusions). A text's
code length under a language is the exact sum over its bytes, and the language
with the shortest code wins.

As the statistics are frozen, the code lengths of every context and byte that a
language has seen are worked out once. Languages go in groups of ``GROUP``; a
group has a row of lengths for each context and byte that any of its languages
saw, and one of escapes for each context, found by hashing. So tables grow with
what was learnt, nothing is left out, and scoring a byte is most often one
look-up for all languages of a group.

The trees are learnt from a stratified sample of labelled rows: all rows of a
language up to about ``FIT_ROWS``, chosen by a hash of the id, whole texts.

Scores are the winning language's share of sum(2 ** -length). Text is
lower-cased, and every run of bytes that are neither letters nor beyond ASCII
counts as one space, so digits and markup do not vote.

Defined cases: a null text and a text without any letter are ``und`` with
score 0; so is every text where no row teaches a language. Equal code lengths
go to the first language in code-point order. Null languages teach nothing.
Rows are scored one by one, so repeated rows need no care, and other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm.common import broadcast_if_small, held_out, written
from vicinal.session import table

ORDER = 3
#: About so many rows of a language are learnt from.
FIT_ROWS = 4000
#: Languages that share tables.
GROUP = 16
UNDETERMINED = "und"

_SPACES = re.compile(rb"[^a-z\x80-\xff]+")


def normal(text: str) -> bytes:
    """Lower case in UTF-8 with one space around and between words."""
    return b" " + _SPACES.sub(b" ", text.lower().encode("utf-8", "surrogatepass")).strip() + b" "


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter."""
    return text is not None and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def gram_codes(data: bytes) -> np.ndarray:
    """The codes of all 4-byte windows of the data, with two more spaces before it."""
    b = np.frombuffer(b"  " + data, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n: how often each 4-byte window occurs in the texts of each language.

    Each task adds up its own rows first, so a row a language, window and task is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if has_letter(text := text.as_py()):
                    codes, n = np.unique(gram_codes(normal(text)), return_counts=True)
                    totals.setdefault(lang, Counter()).update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
        for lang, grams in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams), pa.int64()), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fitting_rows(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Labelled rows to learn from: all of a language up to about ``fit_rows``, else a share by hash."""
    labelled = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    share = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("fit")), 11).cast("double") * F.lit(2.0**-53)
    return labelled.join(broadcast_if_small(written(sizes, "languages")), "lang").filter(share * F.col("_rows") < fit_rows).select("lang", "text")


class Keys:
    """Places of 32-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = keys.astype(np.uint32)
        self.keys = np.append(keys, np.uint32(0))  # the last stands in where there is none
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            slots, own = np.unique(at[free], return_index=True)
            self.slots[slots] = left[free][own]
            rest = self.slots[at] != left
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not there."""
        at = self._first(keys)
        out = self.slots[at]
        far = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(far):
            at[far] = (at[far] + 1) & self.mask
            out[far] = self.slots[at[far]]
            far = far[(out[far] >= 0) & (self.keys[out[far]] != keys[far])]
        return out


class Tables:
    """Code lengths under the languages of a group.

    For each order: the windows (context and next byte) that any language saw,
    with their lengths, and the contexts, with the languages' escapes, which
    are 0 where a language never saw the context.
    """

    def __init__(self, trees: list[list[dict]], size: int) -> None:
        n = len(trees)
        self.orders: list[tuple[Keys, np.ndarray, Keys, np.ndarray]] = []
        self.base = np.full((256, n), np.log2(size), np.float32)
        below: dict[tuple, np.ndarray] = {}
        for order in range(ORDER + 1):
            contexts = sorted({c for t in trees for c in t[order]})
            escapes = np.zeros((len(contexts), n), np.float32)
            rows: dict[tuple, np.ndarray] = {}
            for i, c in enumerate(contexts):
                for j, tree in enumerate(trees):
                    if seen := tree[order].get(c):
                        escapes[i, j] = np.log2((sum(seen.values()) + len(seen)) / len(seen))
                for symbol in {s for tree in trees for s in tree[order].get(c, ())}:
                    # A shorter window of the same bytes was seen as well.
                    row = (below[(*c[1:], symbol)] if order else self.base[symbol]) + escapes[i]
                    for j, tree in enumerate(trees):
                        if (seen := tree[order].get(c)) and symbol in seen:
                            row[j] = np.log2((sum(seen.values()) + len(seen)) / seen[symbol])
                    rows[(*c, symbol)] = row
            if order:
                code = lambda window: int.from_bytes(bytes(window))
                windows = np.array(list(rows.values()), np.float32).reshape(-1, n)
                self.orders.insert(0, (Keys(np.array([code(w) for w in rows], np.int64)), windows, Keys(np.array([code(c) for c in contexts], np.int64)), escapes))
            else:
                self.base += escapes.sum(axis=0)  # order 0 has one context, or none
                for (symbol,), row in rows.items():
                    self.base[symbol] = row
            below = rows

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last bytes of 4-byte windows after the bytes before them, added up."""
        total = np.zeros(self.base.shape[1])
        for (windows, lengths, contexts, escapes), mask in zip(self.orders, (0xFFFFFFFF, 0xFFFFFF, 0xFFFF), strict=True):
            codes = codes & np.uint32(mask)
            at = windows.find(codes)
            total += lengths[at[at >= 0]].sum(axis=0, dtype=np.float64)
            codes = codes[at < 0]
            if not len(codes):
                return total
            at = contexts.find(codes >> np.uint32(8))
            total += escapes[at[at >= 0]].sum(axis=0, dtype=np.float64)
        return total + self.base[codes & np.uint32(0xFF)].sum(axis=0, dtype=np.float64)


class Model:
    """Frozen statistics of all languages as look-up tables."""

    def __init__(self, grams: dict[str, dict[int, int]]) -> None:
        """grams: of each language, the counts of its 4-byte windows."""
        self.langs = sorted(grams)
        self.size = 1 + len({code & 255 for g in grams.values() for code in g})
        self.groups = [Tables([self._tree(grams[x]) for x in self.langs[at : at + GROUP]], self.size) for at in range(0, len(self.langs), GROUP)]
        #: Bits a byte beyond which a text is noise: those of a code that knows nothing, and more the less a language has settled.
        self.noise = {x: float(np.log2(self.size) * (1 + len(g) / max(1, sum(g.values())))) for x, g in grams.items()}

    @staticmethod
    def _tree(grams: dict[int, int]) -> list[dict[tuple, dict[int, int]]]:
        """By order, the counts of each symbol after each context."""
        tree: list[dict[tuple, dict[int, int]]] = [{} for _ in range(ORDER + 1)]
        for code, n in grams.items():
            b = (code >> 24, code >> 16 & 255, code >> 8 & 255, code & 255)
            for order in range(ORDER + 1):
                at = tree[order].setdefault(b[ORDER - order : ORDER], {})
                at[b[3]] = at.get(b[3], 0) + n
        return tree

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of the data's code under each language."""
        codes, total = gram_codes(data), np.zeros(len(self.langs))
        for at in range(0, len(codes), 1 << 16):
            total += np.concatenate([g.bits(codes[at : at + (1 << 16)]) for g in self.groups])
        return total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, bits a byte."""
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0
        data = normal(text)
        bits = self.code_lengths(data)
        best = int(np.argmin(bits))
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), float(bits[best] / (len(data) - 1))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that are not held out.

    What comes to the driver is one number for each language and 4-byte window
    of the sample, which ``fit_rows`` bounds.
    """
    grams: dict[str, dict[int, int]] = {}
    counts = count_grams(fitting_rows(docs.filter(~held_out()), fit_rows)).toArrow()
    for lang, gram, n in zip(*[c.to_pylist() for c in counts.columns], strict=True):
        grams.setdefault(lang, {})[gram] = n
    return Model(grams)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and bits_per_byte from its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column(0)]
            columns = [*batch.columns[1:], pa.array([x[0] for x in found], pa.string()), *(pa.array([x[i] for x in found], pa.float64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col("text").alias("_text"), *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "lang_pred string, score double, bits_per_byte double"])
    return rows.mapInArrow(score, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is determined and whose text is not noise.

    Noise costs more bits a byte than a code that knows nothing of the text,
    by the share of windows that the language is still to learn: new windows
    among those that it was learnt from. Where nothing could be learnt, every text with a letter is accepted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(text: str | None) -> bool:
        if not shared.value.langs:
            return has_letter(text)
        lang, _, bits = shared.value.predict(text)
        return lang != UNDETERMINED and bits <= shared.value.noise[lang]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([keep(x.as_py()) for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every document."""
    model = fit(docs, fit_rows)
    out = predict(docs, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op9_ppm_language": op9_ppm_language}
ORACLE_SQL: dict[str, str] = {}
