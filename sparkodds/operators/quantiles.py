"""Exact interpolated quantiles that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkodds.session import materialize


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """One row per group with ``n`` and the named continuous quantiles. With
    ``weight``, a row stands for that many equal values.

    Spark's ``percentile`` is exact too, but holds a group's distinct values in
    one buffer; use it where the domain is bounded (cents, minutes). This one is
    for unbounded values: they are counted (combined map-side), range-partitioned
    on (group, value), which splits a hot group, and only the partition totals
    meet: one row per (group, partition). Ranks then come from a cumulative sum
    inside each partition. The range partitioning is checkpointed, so totals and
    rows refer to the same cut.
    """
    by = list(by)
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(times.alias("_n"))
    cut = materialize(
        counted.repartitionByRange(*[F.col(c) for c in (*by, value)]).withColumn("_part", F.spark_partition_id())
    )
    totals = cut.groupBy(*by, "_part").agg(F.sum("_n").alias("_in_part"))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    offsets = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_part").alias("_by_part"),
        F.coalesce(
            F.sum("_in_part").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_before"),
        F.sum("_in_part").over(group).alias("_total"),
    )
    in_part = Window.partitionBy(*by, "_part").orderBy(value)
    same = F.col("_part") == F.col("_by_part")
    for c in by:  # a NULL group is a group too
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    ranked = (
        cut.withColumn("_cum", F.sum("_n").over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, same)
        .withColumn("_hi", F.col("_before") + F.col("_cum") - 1)  # zero-based last rank of the value
        .withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
    )

    def holds(rank):
        return (F.col("_lo") <= rank) & (rank <= F.col("_hi"))

    picks = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_total") - 1)
        below, above = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when(holds(below), F.col(value))).cast("double").alias(f"_b_{name}"),
            F.max(F.when(holds(above), F.col(value))).cast("double").alias(f"_a_{name}"),
        ]
    result = ranked.groupBy(*by).agg(F.max("_total").alias("n"), *picks)
    out = [F.col("n")]
    for name, p in probs.items():
        at = F.lit(p) * (F.col("n") - 1)
        low, high = F.col(f"_b_{name}"), F.col(f"_a_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return result.select(*by, *out)
