"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Three base kinds are found by pattern, leftmost and non-overlapping for each
kind; a match whose tail is too short is dropped after matching, so it still
hides what it covers.

The entropy kind looks at maximal runs of key characters. Each run has a
character class (hex, alnum, base64) with its own alphabet and threshold. A
window slides over the run; the counts of its characters are kept up to date
by adding the character that enters and taking away the one that leaves, and
with them the sum of c*log2(c), from which the Shannon entropy of the window
follows at once. Windows at or above the class's threshold are merged into
spans. An allow-list suppresses runs that look random and are not secret:
identifiers in UUID form, numbers, dates and rules, and any caller-given
pattern; and names and paths all of whose parts read like words. A part does if
its letters come in few pieces of one case each and, where they are many, pass
between vowels and consonants about as often as words do and random letters
do not, and are seldom rare ones. Runs inside a base span are left to that span.

Defined cases: a null text counts as empty; offsets are code points with an
exclusive end; texts are scanned whole; rows are independent of one another,
so repeated rows, ties and hot groups need no care; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vicinal.session import table

ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: An assignment needs one of these in the text's lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Entropy in bits a character at which a window counts; 20 characters reach log2(20) = 4.32 at most.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"[-+_=/0-9]+",  # numbers, dates, rules
)
#: A part of a name: a word, capitals or a number.
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_JOINTS = re.compile(r"[-_/+=]+")
#: Letters to a piece at least, letters from which a name is long, and of a long one the least share of vowels and of changes between vowel and consonant.
PIECE_LETTERS, LONG_NAME, LEAST_VOWELS, LEAST_CHANGES = 3.5, 12, 0.25, 0.46
#: The most that letters which words seldom have may make up of a long name.
MOST_RARE = 0.2
_VOWELS, _RARE = frozenset("aeiouy"), frozenset("jkqvwxz")

_C_LOG_C = [0.0, *(c * math.log2(c) for c in range(1, 4097))]


def char_class(run: str) -> str:
    """The narrowest class whose alphabet has every character of the run."""
    if re.fullmatch(r"[0-9a-fA-F]+", run):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


def reads_like_words(run: str) -> bool:
    """Whether all parts of a run are words or numbers, of few pieces, with the vowels of a language."""
    parts = [p for p in _JOINTS.split(run) if p]
    for part in parts:
        pieces = _PIECE.findall(part)
        letters = sum(map(str.isalpha, part))
        words = sum(map(str.isalpha, pieces))
        if sum(map(len, pieces)) < len(part) or len(pieces) - words > 1 or words > max(1, letters // PIECE_LETTERS):
            return False
    words = [p.lower() for part in parts for p in _PIECE.findall(part) if p.isalpha()]
    vowels = sum(c in _VOWELS for w in words for c in w)
    letters, pairs = sum(map(len, words)), sum(len(w) - 1 for w in words)
    changes = sum((a in _VOWELS) != (b in _VOWELS) for w in words for a, b in zip(w, w[1:], strict=False))
    rare = sum(c in _RARE for w in words for c in w)
    return letters < LONG_NAME or vowels >= LEAST_VOWELS * letters and changes >= LEAST_CHANGES * pairs and rare <= MOST_RARE * letters


def window_spans(run: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Merged windows of the run with at least ``threshold`` bits a character."""
    counts: dict[str, int] = {}
    total, spans, log_window = 0.0, [], math.log2(window)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += _C_LOG_C[n + 1] - _C_LOG_C[n]
        counts[c] = n + 1
        if i >= window:
            old = run[i - window]
            n = counts[old]
            total += _C_LOG_C[n - 1] - _C_LOG_C[n]
            counts[old] = n - 1
        if i >= window - 1 and log_window - total / window >= threshold - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


class Scanner:
    """Finds the spans of a text; made once a task."""

    def __init__(self, window: int = WINDOW, thresholds: dict[str, float] | None = None, allowed: tuple[str, ...] = ALLOWED, words: bool = True) -> None:
        if not 2 <= window < len(_C_LOG_C) - 1:
            raise ValueError("the window must have 2 to 4095 characters")
        self.window, self.thresholds = window, thresholds or THRESHOLDS
        self.candidate = CANDIDATE if window == WINDOW else re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % window)
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None
        self.words = words

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the base kinds, in order."""
        out = []
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
        out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
        return sorted(out)

    def entropy(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of high entropy outside the base spans and the allow-list."""
        out, k, reach = [], 0, -1
        for m in self.candidate.finditer(text):
            run, at = m[0], m.start()
            if self.allowed and self.allowed.fullmatch(run) or self.words and reads_like_words(run):
                continue
            for start, end in window_spans(run, self.window, self.thresholds[char_class(run)]):
                # Both sorts of spans come in order of their starts: one sweep over the base spans.
                while k < len(base) and base[k][0] < at + end:
                    reach = max(reach, base[k][2])
                    k += 1
                if reach <= at + start:
                    out.append((at + start, 3, at + end))
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end``, by start and then kind as listed, comma-joined."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, **settings) -> DataFrame:
    """Counts, digest and spans of every document (columns doc_id, text); settings are those of ``Scanner``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**settings)
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = scanner.base(text)
                more = scanner.entropy(text, base)
                kinds = [x[1] for x in base]
                counts.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more)))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + more)))
            columns = [batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE_SQL: dict[str, str] = {}
