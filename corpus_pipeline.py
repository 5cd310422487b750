"""The corpus pipeline: five stages over the documents, each written and read again by the next.

1. language: documents that language identification rejects go (no letters, or
   a text that every language's model finds close to noise).
2. near_duplicates: of each group of near-duplicates the smallest id stays.
3. decontaminate: documents that leak a benchmark passage go.
4. mix: sources come to their target weights; documents are repeated or left
   out whole, as the mix takes them.
5. shard: every remaining row gets its shard and slot.

Rows with a null id or text: a null text has no letters and goes in stage 1; a
row without an id passes stages 2 and 3, which cannot name it. Other columns
are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import decontaminate, language, mixing, neardup, sharding
from vicinal.llm.common import written
from vicinal.session import table

#: Words in a shingle and per cent of similarity of the near-duplicate stage.
SHINGLE_WORDS, PERCENT = 5, 80
SHARDS = 16


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know."""
    return language.accepted(docs, language.fit(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.one_of_each(docs, SHINGLE_WORDS, PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    ids = written(leaks.select(F.col("doc_id").alias("id")).filter("id is not null").distinct(), "leaks")
    return neardup.restrict(docs, "doc_id", ids, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, slot and the shard after one more joins."""
    return sharding.shard_documents(docs, sharding.even_tree(SHARDS))


STAGES = [("language", identified), ("near_duplicates", deduplicated), ("decontaminate", decontaminated), ("mix", mixed), ("shard", sharded)]
#: Language models, the SVD and the splitting tree's draws are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
