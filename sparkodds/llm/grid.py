"""Vectors against vectors in cells of bounded size.

Candidates are dealt into shards by their id and queries into blocks by theirs; a
cell is one shard and one block. Shards and blocks have about the same number of
rows at any table size, so a cell fits in memory, and the stated queries meet
all candidates without one task or the driver seeing either whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About so many candidates in a shard and queries in a block.
SHARD, BLOCK = 8192, 1024

#: ids null: all of the shard.
PAIRS = "query_id long, shard int, ids array<long>"
FOUND = "query_id long, vec_id long, score double"

#: Ids that follow each other are dealt apart by a multiplication modulo a prime.
_PRIME, _STEP = 1000003, 7919


def parts(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def dealt(key: Column, n: int) -> Column:
    return F.pmod(F.pmod(key, F.lit(_PRIME)) * _STEP, F.lit(n)).cast("int")


def dealt_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """The same for numpy's integers."""
    return (ids % _PRIME) * _STEP % n


def over(df: DataFrame, name: str, n: int) -> DataFrame:
    """Every row once for each of n parts."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def matrix(column: Iterable) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame whose number columns have the schema's types, also without rows."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    kinds = {"long": "int64", "int": "int32", "double": "float64"}
    out = pd.DataFrame(rows, columns=[name for name, _ in fields])
    return out.astype({name: kinds[kind] for name, kind in fields if kind in kinds})


def exact_scores(
    pairs: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    score: Callable[[np.ndarray, np.ndarray], np.ndarray],
    n_shards: int,
    n_blocks: int,
    keep: int,
) -> DataFrame:
    """The ``keep`` smallest scores (ties to the smaller id) of each query and
    shard among its pairs, a pair counting once.

    pairs: PAIRS; vectors: vec_id and vector; queries: query_id and vector.
    ``score`` takes candidate rows and one query's vector."""
    held = over(vectors.select(dealt(F.col("vec_id"), n_shards).alias("shard"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "vector"), "block", n_blocks)
    asks = over(queries.select(dealt(F.col("query_id"), n_blocks).alias("block"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "vector"), "shard", n_shards)
    names = ["block", "shard", "asks", "id", "vector"]
    left = pairs.withColumn("block", dealt(F.col("query_id"), n_blocks))
    right = held.select(names).union(asks.select(names))

    def cell(wanted: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        there = rows[~rows["asks"]].sort_values("id", kind="stable")
        if not len(wanted) or not len(there):
            return frame([], FOUND)
        ids, x = there["id"].to_numpy(np.int64), matrix(there["vector"])
        asked = dict(zip(rows.loc[rows["asks"], "id"], rows.loc[rows["asks"], "vector"], strict=True))
        out = []
        for query_id, hits in wanted.groupby("query_id", sort=False)["ids"]:
            if any(h is None for h in hits):
                at = np.arange(len(ids))
            else:
                at = np.searchsorted(ids, np.unique(np.concatenate(list(hits))))
            s = score(x[at], np.asarray(asked[query_id], dtype=np.float64))
            top = np.lexsort((ids[at], s))[:keep]
            out += zip([query_id] * len(top), ids[at[top]].tolist(), s[top].tolist(), strict=True)
        return frame(out, FOUND)

    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(cell, FOUND)
