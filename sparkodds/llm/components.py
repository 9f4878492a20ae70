"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkodds.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that links of (a, b) reach.

    Large-star and small-star steps by turns: every node hangs its neighbours
    onto the smallest node that it sees, until the edges are stars. A hot node's
    neighbours meet as partial minima and in joins that may be split; the number
    of rounds grows with the logarithm of the longest path."""
    edges = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("at"))
        edges = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        # Every edge now goes from the greater node u to the smaller v.
        least = edges.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
        met = edges.join(least, F.col("u") == F.col("at"))
        small = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
