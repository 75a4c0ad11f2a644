"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.plans.shared import discard, materialize_at


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least of it and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of those."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    return tied.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).where("a < b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges(a, b), the component being the least node that is reachable.

    Both steps run until the edges are stars around their components' least nodes, which takes about the
    logarithm of the longest path; each round is written to the shared folder.
    """
    spark = edges.sparkSession
    tidy = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    at = None
    print_ = (None, None)
    while True:
        tidy, new = materialize_at(_small(_large(tidy)), "components")
        if at:
            discard(spark, at)
        at = new
        seen = tuple(tidy.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == print_:
            return tidy.select(F.col("b").alias("node"), F.col("a").alias("component")).union(tidy.select("a", "a").distinct())
        print_ = seen
