"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives every vector a long string of hash symbols; a symbol is the
largest coordinate, with its sign, of a random rotation. A tree is kept as sorted
arrays of those strings, cut into ranges by the first symbol. A query descends
every tree to its longest matching prefixes; all trees then ascend together, one
symbol at a time and tree by tree, until ``gather`` entries have been met. The
vectors met are ranked by their exact distance.

The whole table is indexed; only the centre that is subtracted before hashing
comes from a sample, about CENTRE_ROWS vectors, those of smallest hash. A query whose
trees end before enough entries are met reaches the root, which holds every
vector. Equal vectors are one entry with their k + 1 smallest ids, since no
result can hold more of them.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another length than the most common
one; of rows that repeat a vec_id the vector that sorts first counts; a query
with fewer than k candidates gets all; without vectors there are no rows. Only
vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkodds.llm import grid
from sparkodds.llm.common import hashed_sample, read
from sparkodds.llm.topk import usable
from sparkodds.session import materialize

#: Rotated coordinates behind a symbol, so 2 * AXES symbols; symbols of a string.
AXES, DEPTH = 64, 4

#: Vectors that the centre is the mean of.
CENTRE_ROWS = 4096

POSTINGS = "tree int, range int, n int, ids array<long>, strings array<long>"


def hash_strings(x: np.ndarray, centre: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """The strings of vectors in a tree: DEPTH symbols, one in each byte."""
    out, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for depth in range(DEPTH):
        turn = np.random.default_rng([seed, tree, depth]).standard_normal((x.shape[1], AXES)).astype(np.float32)
        y = (x - centre).astype(np.float32) @ turn
        axis = np.abs(y).argmax(axis=1)
        out = out << 8 | (2 * axis + (y[rows, axis] > 0))
    return out


def postings(rows: DataFrame, centre: np.ndarray, trees: int, ranges: int, seed: int) -> DataFrame:
    """The strings of (id, vector) rows, packed by tree and range."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            if not len(part):
                continue
            x, ids = grid.matrix(part["vector"]), part["id"].to_numpy(np.int64)
            out = []
            for tree in range(trees):
                strings = hash_strings(x, centre, tree, seed)
                at = (strings >> (8 * (DEPTH - 1))) * ranges // (2 * AXES)
                order = np.argsort(at, kind="stable")
                for piece in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    out.append((tree, int(at[piece[0]]), len(piece), ids[piece], strings[piece]))
            yield grid.frame(out, POSTINGS)

    return rows.select("id", "vector").mapInPandas(parts, POSTINGS)


def in_cells(index: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings dealt into cells (tree, range, slice, block): a crowded range is
    cut into slices of about SHARD entries, and its queries into blocks."""
    size = index.groupBy("tree", "range").agg(F.ceil(F.sum("n") / grid.SHARD).cast("int").alias("slices"))
    load = asked.groupBy("tree", "range").agg(F.ceil(F.sum("n") / grid.BLOCK).cast("int").alias("blocks"))
    cuts = materialize(size.join(load, ["tree", "range"]))
    spread = F.xxhash64(F.element_at("ids", 1))

    def cut(rows: DataFrame, own: str, every: str, n_own: str, n_every: str) -> DataFrame:
        # Renamed, so that the two sides share no column that Spark could mix up.
        limits = cuts.select(*(F.col(c).alias(f"{own}_{c}") for c in cuts.columns))
        met = (F.col("tree") == F.col(f"{own}_tree")) & (F.col("range") == F.col(f"{own}_range"))
        placed = rows.join(limits, met).withColumn(own, F.pmod(spread, F.col(f"{own}_{n_own}")).cast("int"))
        placed = placed.withColumn(every, F.explode(F.sequence(F.lit(0), F.col(f"{own}_{n_every}") - 1)))
        return placed.select(*CELL, *(c for c in rows.columns if c not in CELL))

    return cut(asked, "block", "slice", "blocks", "slices"), cut(index, "slice", "block", "slices", "blocks")


CELL = ["tree", "range", "slice", "block"]


def sorted_array(held: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    strings, ids = np.concatenate(list(held["strings"])), np.concatenate(list(held["ids"]))
    order = np.argsort(strings, kind="stable")
    return strings[order], ids[order]


def matching(strings: np.ndarray, asked: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where, in a sorted array, the strings lie that share a prefix with each asked one."""
    low = 8 * (DEPTH - depth)
    first = (asked >> low) << low
    return np.searchsorted(strings, first), np.searchsorted(strings, first + (np.int64(1) << low))


def descend(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, tree, depth, n): entries whose longest common prefix with the
    query has that depth."""
    schema = "query_id long, tree int, depth int, n long"

    def cell(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return grid.frame([], schema)
        strings, _ = sorted_array(held)
        own, ids = np.concatenate(list(queries["strings"])), np.concatenate(list(queries["ids"]))
        deeper, out = np.zeros(len(own), np.int64), []
        for depth in range(DEPTH, 0, -1):
            low, high = matching(strings, own, depth)
            new = high - low - deeper
            some = np.flatnonzero(new)
            out.append(pd.DataFrame({"query_id": ids[some], "tree": int(held["tree"].iloc[0]), "depth": depth, "n": new[some]}))
            deeper = high - low
        return pd.concat(out).astype({"tree": "int32", "depth": "int32"})

    left, right = in_cells(index, asked)
    found = left.groupBy(*CELL).cogroup(right.groupBy(*CELL)).applyInPandas(cell, schema)
    return found.groupBy("query_id", "tree", "depth").agg(F.sum("n").alias("n"))


def ascend(index: DataFrame, asked: DataFrame, stops: DataFrame, n_shards: int) -> DataFrame:
    """PAIRS of the entries above each query's stop in each tree.

    stops: stop_id, stop_tree and depth."""
    schema = grid.PAIRS
    single = asked.select("tree", "range", F.explode(F.arrays_zip("ids", "strings")).alias("q"))
    kept = single.join(stops, (F.col("tree") == F.col("stop_tree")) & (F.col("q.ids") == F.col("stop_id"))).select(
        "tree",
        "range",
        F.lit(1).alias("n"),
        F.array("q.ids").alias("ids"),
        F.array("q.strings").alias("strings"),
        "depth",
    )

    def cell(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return grid.frame([], schema)
        strings, ids = sorted_array(held)
        own = np.concatenate(list(queries["strings"]))
        low, high = matching(strings, own, queries["depth"].to_numpy(np.int64))
        out = []
        for query_id, a, b in zip(np.concatenate(list(queries["ids"])).tolist(), low, high, strict=True):
            met = ids[a:b]
            at = grid.dealt_ids(met, n_shards)
            order = np.argsort(at, kind="stable")
            for piece in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(met) else []:
                out.append((query_id, int(at[piece[0]]), met[piece]))
        return grid.frame(out, schema)

    left, right = in_cells(index, kept)
    return left.groupBy(*CELL).cogroup(right.groupBy(*CELL)).applyInPandas(cell, schema)


def nearest(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 10,
    trees: int = 64,
    gather: float = 0.45,
    least: int = 2000,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by Euclidean
    distance, ties to the smaller vec_id.

    A query meets ``gather`` times the table's vectors, ``least`` at least,
    counted once for each tree that has them. What that has to be for a recall
    depends on how much nearer the neighbours are than the rest."""
    rows = materialize(usable(embeddings).where(F.exists("vector", lambda x: x != 0)))
    same = Window.partitionBy("vector").orderBy("vec_id")
    copies = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    vectors = materialize(
        copies.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("copies"))
    )
    queries = rows.where(is_query)
    distinct = materialize(queries.groupBy("vector").agg(F.min("vec_id").alias("query_id")))
    n = vectors.count()
    n_shards, n_blocks = grid.parts(n, grid.SHARD), grid.parts(distinct.count(), grid.BLOCK)
    ranges = min(2 * AXES, grid.parts(n, grid.SHARD))

    sample = hashed_sample(vectors, CENTRE_ROWS, "vec_id").select("vec_id", "vector").toPandas().sort_values("vec_id")["vector"]
    centre = grid.matrix(sample).mean(axis=0) if len(sample) else np.zeros(1)
    index = materialize(postings(vectors.withColumnRenamed("vec_id", "id"), centre, trees, ranges, seed))
    asked = materialize(postings(distinct.withColumnRenamed("query_id", "id"), centre, trees, ranges, seed))

    upward = Window.partitionBy("query_id").orderBy(F.desc("depth"), "tree")
    enough = max(least, int(gather * n))
    met = materialize(descend(index, asked).withColumn("met", F.sum("n").over(upward)))
    stops = (
        met.where(F.col("met") - F.col("n") < enough)
        .groupBy(F.col("query_id").alias("stop_id"), F.col("tree").alias("stop_tree"))
        .agg(F.min("depth").alias("depth"))
    )
    full = met.where(F.col("met") >= enough).select("query_id").distinct()
    to_root = grid.over(distinct.join(full, "query_id", "left_anti"), "shard", n_shards).select(
        "query_id", "shard", F.lit(None).cast("array<long>").alias("ids")
    )
    pairs = ascend(index, asked, stops, n_shards).union(to_root)

    def distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.sqrt(((x - q) ** 2).sum(axis=1))

    scored = grid.exact_scores(pairs, vectors, distinct, distance, n_shards, n_blocks, k + 1)
    best = Window.partitionBy("asked").orderBy("score", "vec_id")
    copies_of = vectors.select(F.col("vec_id").alias("entry"), "copies")
    ranked = (
        scored.withColumnsRenamed({"vec_id": "entry", "query_id": "asked"})
        .join(copies_of, "entry")
        .select("asked", "score", F.explode("copies").alias("vec_id"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k + 1)
        .drop("rank")
    )
    each = queries.withColumnRenamed("vec_id", "own").join(distinct.withColumnRenamed("query_id", "asked"), "vector")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        each.select(F.col("own").alias("query_id"), "asked")
        .join(ranked, "asked")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
