"""Files of one JSON array each, read by many tasks: the objects of the array with their places.

A file is cut where Spark cuts it, and text is taken up to each closing brace.
Whether a brace stands in a string, and how deep it lies, depends on all the
text before, so a first pass sums each block up: whether it has an odd number
of quotes, and for either beginning, inside a string or outside, how much
deeper it ends and how many objects it closes at each depth. Sums over the
blocks before tell how each block begins. A second pass then cuts the blocks
into objects. An object that lies across blocks comes in pieces, which are few
and put together by its place.

An object counts where it lies directly in the outermost array, or at another
level that is asked for; what else stands there is left out. Strings may hold braces, brackets, quotes
and escapes. Files may be empty or hold an empty array. Of a file that ends
inside an object, which is not well-formed, that object may come as if one
brace had closed it, or not at all; those before it come whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.session import written
from vicinal.sources.blocks import FEW_BLOCKS, read_blocks

#: kind 0: a whole object; of one that may have begun in a block before: 1, its end; 2, what goes on in the next block.
_PIECES = "file string, block bigint, pos bigint, kind int, value string"
_PIECE_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("kind", pa.int32()), ("value", pa.string())])
_MAP = pa.map_(pa.int64(), pa.int64())
_SUM_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()), ("out", pa.int64()), ("ins", pa.int64()), ("closed_out", _MAP), ("closed_in", _MAP)])


def structure(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes: after how many quotes each stands (itself included), and +1, -1 or 0 for brackets and braces, strings or not."""
    quote = text == 0x22
    slashes = np.flatnonzero(text == 0x5C)
    if len(slashes):
        # An escape begins at every other backslash of a run; what it escapes is no quote.
        begins = np.ones(len(slashes), bool)
        begins[1:] = np.diff(slashes) != 1
        run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        escaped = slashes[(np.arange(len(slashes)) - run) % 2 == 0] + 1
        quote[escaped[escaped < len(text)]] = False
    step = ((text == 0x7B) | (text == 0x5B)).astype(np.int64) - ((text == 0x7D) | (text == 0x5D))
    return np.cumsum(quote), step


class Block:
    """What is known of a block so far: quotes, and for both beginnings (0: outside a string) the depth and the closings by depth."""

    def __init__(self) -> None:
        self.quotes = 0
        self.depth = [0, 0]
        self.closed: tuple[Counter, Counter] = (Counter(), Counter())

    def add(self, text: bytes) -> None:
        data = np.frombuffer(text, np.uint8)
        quotes, step = structure(data)
        inside = (quotes + self.quotes) % 2 == 1
        for begin in (0, 1):
            own = np.where(inside == (begin == 1), step, 0)
            depth = self.depth[begin] + np.cumsum(own)
            ends, times = np.unique(depth[(data == 0x7D) & (own < 0)], return_counts=True)
            self.closed[begin].update(dict(zip(ends.tolist(), times.tolist(), strict=True)))
            self.depth[begin] += int(own.sum())
        self.quotes += int(quotes[-1]) if len(quotes) else 0


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, list[str]]]:
    """(where it begins, file, block, values) of consecutive rows of one block."""
    if not batch.num_rows:
        return
    file = batch.column(0).dictionary_encode().indices.to_numpy()
    block = batch.column(1).to_numpy()
    begins = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
    for at, end in zip(begins, begins[1:], strict=False):
        yield at, batch.column(0)[at].as_py(), int(block[at]), batch.column(2).slice(at, end - at).to_pylist()


def _text(values: list[str]) -> bytes:
    return "".join(v + "}" for v in values).encode()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], Block] = {}
    for batch in batches:
        for _, file, block, values in _runs(batch):
            found.setdefault((file, block), Block()).add(_text(values))
    rows = [(f, n, b.quotes, *b.depth, *(list(c.items()) for c in b.closed)) for (f, n), b in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind.type) for i, kind in enumerate(_SUM_SCHEMA)], schema=_SUM_SCHEMA)


def block_states(text: DataFrame, level: int = 1) -> DataFrame:
    """file, block, inside (0 or 1), depth, before: how each block begins, and the objects that end before it; a written table."""
    kinds = "file string, block bigint, quotes bigint, out bigint, ins bigint, closed_out map<bigint, bigint>, closed_in map<bigint, bigint>"
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    rows = written(text.mapInArrow(_sums, kinds), "sums").withColumn("inside", upto("quotes") % 2)
    within = F.col("inside") == 1
    rows = rows.withColumn("depth", upto(F.when(within, F.col("ins")).otherwise(F.col("out"))))
    ends = F.coalesce(F.try_element_at(F.when(within, F.col("closed_in")).otherwise(F.col("closed_out")), level - F.col("depth")), F.lit(0))
    return written(rows.withColumn("ends", ends).withColumn("before", upto("ends")).select("file", "block", "inside", "depth", "before"), "states")


def _cutter(level: int):
    """Of rows (file, block, value, inside, depth, before), those of a block in order, the rows of ``_PIECES``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        quotes = depth = pos = 0
        # Of an object that is not yet closed: its text in this block, and whether that is all of it.
        going, whole, held = False, False, b""
        rows: list[tuple[str, int, int, int, str]] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PIECE_SCHEMA)], schema=_PIECE_SCHEMA)
            rows.clear()
            return out

        for batch in batches:
            for at, file, block, values in _runs(batch):
                if (file, block) != now:
                    if going:
                        rows.append((*now, pos, 2, held.decode()))
                    now = file, block
                    quotes, depth, pos = (batch.column(i)[at].as_py() for i in (3, 4, 5))
                    going, whole, held = depth > level, False, b""
                text = _text(values)
                data = np.frombuffer(text, np.uint8)
                seen, step = structure(data)
                own = np.where((seen + quotes) % 2 == 0, step, 0)
                deep = depth + np.cumsum(own)
                opens = np.flatnonzero((data == 0x7B) & (own > 0) & (deep == level + 1))
                ends = np.flatnonzero((data == 0x7D) & (own < 0) & (deep == level)) + 1
                for begin, end in zip((opens[np.searchsorted(opens, ends) - 1] if len(opens) else ends).tolist(), ends.tolist(), strict=True):
                    rows.append((file, block, pos, 0 if whole or not going else 1, (held + text[:end] if going else text[begin:end]).decode()))
                    going, whole, held, pos = False, False, b"", pos + 1
                if len(opens) and (not len(ends) or opens[-1] >= ends[-1]):
                    going, whole, held = True, True, text[opens[-1] :]
                elif going:
                    held += text
                quotes, depth = quotes + int(seen[-1]), int(deep[-1])
            yield flush()
        if going:
            rows.append((*now, pos, 2, held.decode()))
        yield flush()

    return cut


def read_objects(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """file, pos, value: the objects at a level of every file's text and their places, from 0; at level 1 they are those of the outermost array."""
    text = read_blocks(spark, path, "}")
    states = block_states(text, level)
    if states.count() <= FEW_BLOCKS:
        rows = text.join(F.broadcast(states), ["file", "block"])
    else:  # a shuffle takes the rows of a block apart
        rows = text.withColumn("n", F.monotonically_increasing_id()).join(states, ["file", "block"])
        rows = rows.repartition("file", "block").sortWithinPartitions("file", "block", "n")
    cut = rows.select("file", "block", "value", "inside", "depth", "before").mapInArrow(_cutter(level), _PIECES)
    whole = cut.filter("kind = 0").select("file", "pos", "value")
    pieces = cut.filter("kind > 0").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("p"), F.min("kind").alias("kind"))
    return whole.union(pieces.filter("kind = 1").select("file", "pos", F.array_join("p.value", "").alias("value")))
