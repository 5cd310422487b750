"""Connected components of a table of links, without collecting links or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b).

    Alternates two steps until nothing changes: hook every larger neighbour of
    a node to the smallest node around it, then every smaller one (large-star
    and small-star), which converges in about log(nodes) rounds. Both steps are
    a minimum with map-side combining and an equi-join, so a hub with a third
    of all links is combined before it is shuffled and its join may be split.
    Each round is a written table, so lineage stays short.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    same = False
    while not same:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(low, F.col("u") == F.col("x")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        same = edges.exceptAll(after).isEmpty() and after.exceptAll(edges).isEmpty()
        edges = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
