"""Build an index from labelled reference vectors in JSON.

spark-submit -m vicinal.jobs.build_index REFERENCES INDEX --clusters 2048 [--iterations N] [--sample N] [--dims 14]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from vicinal.operators import index, kmeans
from vicinal.session import ship, written
from vicinal.sources.references import read_references


def build(spark: SparkSession, references: str, path: str, clusters: int, iterations: int = kmeans.ITERATIONS, sample: int = 0, dims: int | None = 14) -> dict[str, int]:
    """Read, cluster, quantize and write; returns the numbers of rows and clusters and the records that were left out."""
    rows = written(read_references(spark, references, dims, keep_bad=True), "references")
    good = rows.filter("good").drop("good")
    index.write(good, path, clusters, iterations=iterations, sample=sample)
    n = index.load(spark, path, clusters).refs.count()
    return {"rows": n, "clusters": clusters, "left_out": rows.count() - n}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("references")
    p.add_argument("index")
    p.add_argument("--clusters", type=int, required=True)
    p.add_argument("--iterations", type=int, default=kmeans.ITERATIONS)
    p.add_argument("--sample", type=int, default=0)
    p.add_argument("--dims", type=int, default=14)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("build-index").getOrCreate()
    ship(spark)
    found = build(spark, a.references, a.index, a.clusters, a.iterations, a.sample, a.dims)
    print(" ".join(f"{k}={v}" for k, v in found.items()))


if __name__ == "__main__":
    main()
