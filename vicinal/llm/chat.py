r"""Chat formatting after cumulative-snapshot collapse, in DataFrame expressions only.

Chat logs often hold a conversation again and again, each time a few turns
longer. A prefix hash rolls over the turns of every conversation: each turn
adds two 64-bit hashes of its place, role and text, kept as sums of 32-bit
halves that do not overflow, so the hash of a prefix is a running sum. A
conversation whose whole hash is the hash of a proper prefix of another one, with
the same role and text digest in the prefix's last turn, is an earlier snapshot;
an anti-join removes it. Of equal conversations the smallest conv_id stays.
What remains is rendered. Marks of turns inside roles and texts are escaped
(``<|`` becomes ``<\|``, and ``<\`` becomes ``<\\``), so no text can pass for a turn.

Running sums are taken in two levels, inside chunks of ``CHUNK`` turns and over
the chunks' totals, so a conversation with a third of all turns is spread over
many tasks. Prefix hashes are made distinct, with map-side combining, before
they meet, so a first turn that very many conversations share is one row.
Rendered texts come in segments of ``SEGMENT`` turns for the same reason.

Defined cases: rows without conv_id belong to no conversation and are left
out; turns are ordered by number (nulls first), role and the text's digest; a
turn that is logged twice counts once; a null role or text is rendered as
empty and differs from no other empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.llm.common import written
from vicinal.session import table

CHUNK = 256
SEGMENT = 64
_SUMS = ("s1", "s2", "s3", "s4")


def _turns(conversations: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("digest")
    )


def _before(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """conv_id, chunk and, by name, the total of each column over the conversation's earlier chunks."""
    totals = rows.groupBy("conv_id", "chunk").agg(*(F.sum(c).alias(c) for c in sums))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("conv_id", "chunk", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for c, name in sums.items()))


def _halves(value: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(0xFFFFFFFF))


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, place (from 1), n_turns and the prefix hash s1..s4 up to each turn, as a written table."""
    light = _turns(conversations).select("conv_id", "turn", "role", "digest").distinct()
    # Whole chunks of turn numbers; the order of chunks is the order of turns.
    light = light.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62)))).withColumn("one", F.lit(1))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    numbered = light.withColumn("within", F.row_number().over(inside)).join(_before(light, {"one": "earlier"}), ["conv_id", "chunk"])
    numbered = numbered.withColumn("place", (F.col("within") + F.col("earlier")).cast("long"))
    first, second = _halves(F.xxhash64("place", "role", "digest")), _halves(F.xxhash64("digest", "role", F.lit("again"), "place"))
    terms = numbered.select("conv_id", "chunk", "turn", "role", "digest", "place", *(c.alias(s) for c, s in zip((*first, *second), _SUMS, strict=True)))
    running = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = terms.select("conv_id", "chunk", "turn", "role", "digest", "place", *(F.sum(s).over(running).alias(s) for s in _SUMS))
    rolled = rolled.join(_before(terms, {s: f"{s}_before" for s in _SUMS}), ["conv_id", "chunk"])
    sizes = light.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    out = rolled.join(sizes, "conv_id")
    return written(out.select("conv_id", "turn", "role", "digest", "place", "n_turns", *((F.col(s) + F.col(f"{s}_before")).alias(s) for s in _SUMS)), "prefixes")


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that are no snapshot of a longer one."""
    key = ["place", *_SUMS, "role", "digest"]
    whole = prefixes.filter("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = prefixes.filter("place < n_turns").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "copies")


def escaped(text: Column) -> Column:
    """The text with its own marks of turns made plain."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def render(turns: Column) -> Column:
    """The text of an ordered array of turns (structs with role and text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), escaped(t["role"]), F.lit("|>\n"), escaped(t["text"]), F.lit("<|end|>\n"))), "")


def collapsed_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, segment, rendered of the maximal conversations."""
    prefixes = turn_prefixes(conversations)
    kept = maximal_conversations(prefixes)
    places = prefixes.select("conv_id", "turn", "role", "digest", "place").join(kept, "conv_id").withColumnRenamed("turn", "_turn")
    texts = _turns(conversations)
    same = (F.col("t.conv_id") == F.col("p.conv_id")) & F.col("t.turn").eqNullSafe(F.col("p._turn")) & (F.col("t.role") == F.col("p.role")) & (F.col("t.digest") == F.col("p.digest"))
    rows = texts.alias("t").join(places.alias("p"), same).select("p.conv_id", "p.n_turns", "p.copies", "p.place", "t.role", "t.text")
    grouped = rows.groupBy("conv_id", "n_turns", "copies", F.floor((F.col("place") - 1) / SEGMENT).cast("int").alias("segment"))
    return grouped.agg(render(F.array_sort(F.collect_set(F.struct("place", "role", "text")))).alias("rendered"))


def op5_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered maximal conversations."""
    return collapsed_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op5_chat_snapshots": op5_chat_snapshots}
ORACLE_SQL = {
    "op5_chat_snapshots": """
    WITH t AS (
        SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL
    ), p AS (
        SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
            sha256(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS prefix
        FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))
    ), whole AS (
        SELECT place, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE place = n_turns GROUP BY place, prefix
    ), kept AS (
        SELECT conv_id, copies FROM whole w
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n_turns AND p.place = w.place AND p.prefix = w.prefix)
    )
    SELECT p.conv_id, p.n_turns, k.copies, CAST((p.place - 1) // 64 AS INTEGER) AS segment,
        string_agg('<|' || replace(replace(role, '<\\', '<\\\\'), '<|', '<\\|') || '|>' || chr(10) || replace(replace(text, '<\\', '<\\\\'), '<|', '<\\|') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
    FROM p JOIN kept k USING (conv_id) GROUP BY ALL
    """
}
