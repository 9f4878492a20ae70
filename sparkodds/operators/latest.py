"""Latest-row-per-key, upserts and bookkeeping joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkodds.functions.timefn import col
from sparkodds.operators.unions import union


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the last in ``order``. An aggregate, so copies of a hot
    key are reduced map-side before the shuffle instead of meeting in a window."""
    rest = [c for c in df.columns if c not in keys]
    position = F.struct(*[col(c) for c in order])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), position).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    position = F.struct(*[col(c) for c in order])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), position).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def merge_tiers(
    tiers: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Union of tiers, one row per key; a later tier wins, then ``order``."""
    tagged = [t.withColumn("_tier", F.lit(i)) for i, t in enumerate(tiers)]
    merged = union(*tagged, missing=True)
    return keep_last(merged, keys, ["_tier", *order]).drop("_tier")


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Insert-or-replace by key, columns matched by name."""
    return merge_tiers([existing, incoming], keys, order)


def delete_insert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of keys absent from ``incoming`` stay, all of ``incoming`` is added
    (several rows of one key stay several)."""
    kept = existing.join(incoming.select(key).distinct(), key, "left_anti")
    return union(kept, incoming, missing=True)


def missing_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Distinct keys used by children that no parent row has."""
    return children.select(key).distinct().join(parents.select(key), key, "left_anti")


def not_in(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key a bookkeeping table does not list."""
    return df.join(done.select(key), key, "left_anti")
