"""URL filters: rules by host and path, looked up in a sorted digest array.

A rule is a host, which holds for its subdomains too, and the beginning of a
path. The list is an array of 64-bit xxhash keys in order, with the strings
themselves behind it, in a file that tasks map into memory: what is not probed
is not read, and the workers of a machine share its pages. A batch of urls is
looked up by one binary search for all its candidate keys; equal keys are
confirmed on the stored strings, so that a collision cannot judge a url.

Two arrays serve a url. The first has the rules' hosts with the lengths of
their paths; it is probed with every suffix of the url's host. The second has
the whole rules; it is probed with those hosts and the beginnings of the url's
path that have these lengths. Of the rules that fit the longest wins, of
equally long ones that with the longer host.

A list of at most ``MOST_RULES`` rules and ``MOST_BYTES`` bytes, which is
checked, is made into arrays on the driver and sent as files; a longer one is
met by joins on the same candidates, with the same result.

Host: what follows the first ``://``, up to ``/``, ``?``, ``#`` or the end,
with A-Z lower-cased. Path: what follows, up to ``?``, ``#`` or the end.

Defined cases: a null url, and one without ``://``, has an empty host and an
empty path; no rule fits an empty host but one with an empty host; of a very long
host only as many labels are looked at as a rule has; a url that
no rule fits gets the default verdict; a rule given twice blocks if one of the
two does; a rule's path begins with ``/`` or is empty; an empty table gives an
empty result; columns with the name of an output are replaced.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from vicinal.llm.common import written
from vicinal.session import table

#: Lists of up to so many rules and bytes are sent to the executors as files.
MOST_RULES, MOST_BYTES = 2_000_000, 256 << 20
ALLOW, BLOCK = "allow", "block"
OUTPUTS = ("host", "path", "rule", "verdict")
#: (verdict, host, path)
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def suffixes(host: str, most: int) -> list[str]:
    """The host and the domains that it is a subdomain of, of those with at most ``most`` labels."""
    *rest, last = host.rsplit(".", most)
    out = [last] if last or not rest else []
    for label in reversed(rest[-(most - 1) :] if most > 1 else []):
        last = f"{label}.{last}"
        out.append(last)
    return out


class DigestArray:
    """A file of strings with a number each, in the order of their digests, mapped into memory.

    Layout: the number of entries; their keys; where each string ends; the
    numbers; the strings. A string may occur with several numbers.
    """

    def __init__(self, path: str, digest=None) -> None:
        n = int(np.fromfile(path, np.int64, 1)[0])
        part = lambda kind, at: np.memmap(path, kind, "r", 8 + 8 * n * at, n) if n else np.zeros(0, kind)
        self.keys, self.ends, self.numbers = part(np.uint64, 0), part(np.int64, 1), part(np.int64, 2)
        self.text = np.memmap(path, np.uint8, "r", 8 + 24 * n) if n and self.ends[-1] else np.zeros(0, np.uint8)
        self.digest = digest or _digest

    def string(self, i: int) -> bytes:
        return self.text[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()

    def find(self, asked: list[bytes]) -> Iterator[tuple[int, int]]:
        """(place in ``asked``, number) of all entries that are equal to an asked string."""
        keys = np.fromiter(map(self.digest, asked), np.uint64, len(asked))
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(first < last).tolist():
            for j in range(first[i], last[i]):
                if self.string(j) == asked[i]:
                    yield i, int(self.numbers[j])


def _digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 42)


def write_digest_array(entries: Iterable[tuple[bytes, int]], path: str, digest=None) -> None:
    """Write the file of a ``DigestArray``."""
    rows = sorted(((digest or _digest)(text), text, number) for text, number in set(entries))
    with open(path, "wb") as f:
        for part in (np.array([len(rows)], np.int64), np.array([r[0] for r in rows], np.uint64), np.cumsum([len(r[1]) for r in rows], dtype=np.int64), np.array([r[2] for r in rows], np.int64)):
            f.write(part.tobytes())
        f.writelines(r[1] for r in rows)


def _checked(rules: DataFrame) -> DataFrame:
    """host, path, block of distinct rules, hosts in small letters, as a written table."""
    rows = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", (F.col("verdict") == BLOCK).alias("block"))
    rows = written(rows.groupBy("host", "path").agg(F.max("block").alias("block")), "rules")
    if not rows.filter(F.col("path").isNull() | F.col("host").isNull() | F.col("block").isNull() | F.col("host").contains("/") | ((F.col("path") != "") & ~F.startswith("path", F.lit("/")))).isEmpty():
        raise ValueError("a rule has a verdict, a host without / and a path that is empty or begins with /")
    return rows


def _sent(spark: SparkSession, rules: DataFrame) -> tuple[str, str]:
    """The names of the two files of a bounded list, sent to all executors."""
    rows = [(r["host"], r["path"], int(r["block"])) for r in rules.toLocalIterator()]
    folder, tag = tempfile.mkdtemp(prefix="vicinal-urls-"), uuid.uuid4().hex
    names = f"hosts-{tag}", f"rules-{tag}"
    write_digest_array(((host.encode(), len(path)) for host, path, _ in rows), f"{folder}/{names[0]}")
    write_digest_array((((host + path).encode(), 2 * len(host) + block) for host, path, block in rows), f"{folder}/{names[1]}")
    for name in names:
        spark.sparkContext.addFile(os.path.join(folder, name))
    return names


class Filter:
    """The two arrays, in a task."""

    def __init__(self, hosts: DigestArray, rules: DigestArray, labels: int) -> None:
        self.hosts, self.rules, self.labels = hosts, rules, labels

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """The longest rule that fits each (host, path), and its verdict."""
        asked, owner = [], []
        for i, (host, _) in enumerate(urls):
            parts = suffixes(host, self.labels)
            asked += parts
            owner += [i] * len(parts)
        tried, whose = [], []
        for at, length in self.hosts.find([x.encode() for x in asked]):
            path = urls[owner[at]][1]
            if length <= len(path):
                tried.append(asked[at] + path[:length])
                whose.append(owner[at])
        best: list[tuple[int, int, str, str] | None] = [None] * len(urls)
        for at, number in self.rules.find([x.encode() for x in tried]):
            found = len(tried[at]), number >> 1, tried[at], BLOCK if number & 1 else ALLOW
            if best[whose[at]] is None or best[whose[at]] < found:
                best[whose[at]] = found
        return [b and b[2:] for b in best]


def _by_array(rows: DataFrame, rules: DataFrame, labels: int) -> DataFrame:
    names = _sent(rows.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Filter(*(DigestArray(SparkFiles.get(name)) for name in names), labels).judge
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = judge(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f and f[i] for f in found], pa.string()) for i in (0, 1))], names=["row", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("rule", StringType()).add("verdict", StringType()))


def _by_joins(rows: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """The same for a list of any length: candidates meet the rules' hosts, then the whole rules, by equi-joins."""
    rows = written(rows.withColumn("_n", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", r"\.")
    parts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # A trailing dot leaves an empty last label, which is no domain unless it is the host.
    asked = rows.select("_n", "path", F.explode(F.filter(parts, lambda x: (x != "") | (F.col("host") == ""))).alias("domain"))
    lengths = rules.select(F.col("host").alias("domain"), F.length("path").alias("length")).distinct()
    tried = asked.join(lengths, "domain").filter(F.length("path") >= F.col("length")).select("_n", F.col("domain").alias("host"), F.substring("path", F.lit(1), F.col("length")).alias("path"))
    found = tried.join(rules, ["host", "path"]).select("_n", F.concat("host", "path").alias("rule"), F.length("host").alias("h"), "block")
    best = found.groupBy("_n").agg(F.max(F.struct(F.length("rule"), "h", "rule", "block")).alias("b"))
    verdict = F.when(F.col("b.block"), BLOCK).when(F.col("b").isNotNull(), ALLOW)
    return rows.join(best, "_n", "left").select("row", "host", "path", F.col("b.rule").alias("rule"), verdict.alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW, most_rules: int = MOST_RULES) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict, by ``rules`` (verdict, host, path)."""
    carried = [c for c in pages.columns if c not in OUTPUTS]
    address = F.col(f"`{url}`").cast("string")
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), host_of(address).alias("host"), path_of(address).alias("path"))
    rules = _checked(rules)
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)).alias("bytes"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    judged = (_by_array if size["n"] <= most_rules and size["bytes"] <= MOST_BYTES else _by_joins)(rows, rules, size["labels"] or 1)
    return judged.select(*(F.col(f"row.`{c}`") for c in carried), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


RULES: list[Rule] = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page's url; what no rule fits is allowed."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_FITS = " ".join(
    f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{path}') THEN '{verdict}{host}{path}'" for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
_SQL = f"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages), r AS (SELECT *, CASE {_FITS} END AS fit FROM p)
SELECT page_id, host, path, substr(fit, 6) AS rule, coalesce(substr(fit, 1, 5), '{ALLOW}') AS verdict FROM r"""

QUERIES = {"op13_url_filter": op13_url_filter}
ORACLE_SQL = {"op13_url_filter": _SQL}
