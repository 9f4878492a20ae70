"""Exact top-k by inner product, by a uniform threshold in three phases.

A score is the sum of one entry from each of ``lists`` lists: list b holds every
candidate's inner product with the query over the b-th part of the dimensions.

1. Each piece of a list gives its own k highest entries. The candidates seen are
   scored; the k-th best score is a cutoff that no result can lie below.
2. The cutoff goes back to the lists. A candidate that reaches it has an entry of
   at least cutoff / lists in some list, so each list gives just those entries.
3. Their candidates are scored exactly, and the best k remain.

Lists live in cells (see grid.py): pieces of candidates by blocks of queries.
Entries travel packed, one row for each query and piece.

Defined results: null vectors and those with null or non-finite components take
no part, nor do those of another length than the most common one; of rows that
repeat a vec_id the vector that sorts first counts; a query with fewer
candidates than k gets all; without vectors there are no rows. Only vec_id and
embedding are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkodds.llm import grid
from sparkodds.llm.common import read
from sparkodds.session import materialize


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector of doubles), one row for each vec_id."""
    kept = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )
    kept = kept.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    common = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return (
        kept.join(common.select("n"), F.size("vector") == F.col("n"), "left_semi")
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


def quantised(scale: int = 64) -> Callable[[Column], Column]:
    """floor(scale * x) of each component."""
    return lambda v: F.transform(v, lambda x: F.floor(x * scale).cast("double"))


def list_entries(
    vectors: DataFrame,
    queries: DataFrame,
    lists: int,
    n_shards: int,
    n_blocks: int,
    pick: Callable[[np.ndarray, pd.DataFrame], Iterable[np.ndarray]],
) -> DataFrame:
    """PAIRS of what ``pick`` takes from each piece of each list: given the
    entries (queries by candidates) and the queries' rows, positions for each
    query. queries has query_id, vector and what pick reads besides."""
    dims = F.ceil(F.size("vector") / lists).cast("int")
    part = F.slice("vector", F.col("list") * dims + 1, dims)
    extra = [c for c in queries.columns if c not in ("query_id", "vector")]
    asked = queries.withColumn("block", grid.dealt(F.col("query_id"), n_blocks))
    asked = grid.over(grid.over(asked, "shard", n_shards), "list", lists)
    held = vectors.withColumn("shard", grid.dealt(F.col("vec_id"), n_shards))
    held = grid.over(grid.over(held, "block", n_blocks), "list", lists)
    keys = ["list", "shard", "block"]
    left = asked.select(*keys, "query_id", part.alias("vector"), *extra)
    right = held.select(*keys, "vec_id", part.alias("vector"))

    def cell(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return grid.frame([], grid.PAIRS)
        held = held.sort_values("vec_id", kind="stable")
        ids, own = held["vec_id"].to_numpy(np.int64), asked["query_id"].to_numpy(np.int64)
        entries = grid.matrix(asked["vector"]) @ grid.matrix(held["vector"]).T
        entries[ids[None, :] == own[:, None]] = -np.inf
        shard = int(held["shard"].iloc[0])
        rows = []
        for query_id, at, e in zip(own.tolist(), pick(entries, asked), entries, strict=True):
            at = at[e[at] > -np.inf]
            if len(at):
                rows.append((query_id, shard, ids[at]))
        return grid.frame(rows, grid.PAIRS)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, grid.PAIRS)


def top_k(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 20,
    lists: int = 2,
    shape: Callable[[Column], Column] = quantised(),
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products,
    ties to the smaller vec_id. Scores are exact for whole-numbered components."""
    vectors = materialize(usable(embeddings).withColumn("vector", shape(F.col("vector"))))
    queries = vectors.where(is_query).withColumnRenamed("vec_id", "query_id")
    n_shards, n_blocks = grid.parts(vectors.count(), grid.SHARD), grid.parts(queries.count(), grid.BLOCK)

    def highest(entries: np.ndarray, asked: pd.DataFrame) -> Iterable[np.ndarray]:
        if entries.shape[1] <= k:
            return [np.arange(entries.shape[1])] * len(entries)
        return list(np.argpartition(-entries, k - 1, axis=1)[:, :k])

    def reaching(entries: np.ndarray, asked: pd.DataFrame) -> Iterable[np.ndarray]:
        least = (asked["cutoff"].to_numpy(np.float64) / lists)[:, None]
        # Sums of components that aren't whole may be rounded.
        reach = entries >= least - 1e-9 * np.where(np.isfinite(least), 1 + np.abs(least), 0)
        return (np.flatnonzero(r) for r in reach)

    def negative(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        return -(x @ q)

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    first = list_entries(vectors, queries, lists, n_shards, n_blocks, highest)
    seen = grid.exact_scores(first, vectors, queries, negative, n_shards, n_blocks, k)
    kth = seen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    cut = queries.join(kth.select("query_id", (-F.col("score")).alias("cutoff")), "query_id", "left")
    # Fewer than k candidates in all: nothing may be left out.
    cut = materialize(cut.withColumn("cutoff", F.coalesce("cutoff", F.lit(float("-inf")))))
    enough = list_entries(vectors, cut, lists, n_shards, n_blocks, reaching)
    scored = grid.exact_scores(enough, vectors, queries, negative, n_shards, n_blocks, k)
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", (-F.col("score")).alias("score"))
    )


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.withColumn("score", F.col("score").cast("long"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
