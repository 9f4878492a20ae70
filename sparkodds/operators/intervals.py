"""Interval joins and blackout exclusion without theta joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkodds.functions.timefn import micros
from sparkodds.session import materialize


#: Bins of one level are so many times as wide as those of the level below.
STEP, LEVELS = 8, 16


def _level(length: Column, width: int) -> Column:
    """The greatest level whose bins are no wider than an interval."""
    level = F.lit(0)
    for k in range(1, LEVELS):
        if width * STEP**k < 2**62:
            level = F.when(length >= width * STEP**k, k).otherwise(level)
    return level


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    ts: str,
    start: str,
    end: str,
    bin_seconds: float = 3600.0,
) -> DataFrame:
    """Points joined to every interval of the same key with start <= ts < end.

    Intervals are listed by time bin, so the join is an equi-join on (key, bin): a
    hot key is spread over its bins and a point meets only intervals near it. Bins
    come in levels, each STEP times as wide as the one below, and an interval is
    listed in the widest bins that are no wider than itself: at most STEP + 1 times
    from ``bin_seconds`` on, however long it is. A point is listed once for each
    level that intervals are in, which is one where they are about as long.

    The intervals are computed once: they are written with their bins, so that
    Spark knows their size when it chooses a join, and the written table says which
    levels there are and the time that they span, which prunes the points' files.
    The points are read by the join alone; nothing is broadcast by hint.
    """
    width = int(bin_seconds * 1_000_000)
    known = intervals.filter(F.col(start) < F.col(end)).withColumn("_level", _level(micros(end) - micros(start), width))
    widths = [min(width * STEP**k, 2**62) for k in range(LEVELS)]
    wide = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in widths)), F.col("_level") + 1)
    # the end is exclusive: an interval ending on a bin edge does not reach into it
    from_bin, to_bin = (F.floor(at / wide.cast("decimal(20,0)")).cast("bigint") for at in (micros(start), micros(end) - 1))
    binned = materialize(known.withColumn("_bin", F.explode(F.sequence(from_bin, to_bin))))
    low, high, levels = binned.agg(F.min(start).cast("string"), F.max(end).cast("string"), F.collect_set("_level")).first()
    kind = dict(points.dtypes)[ts]
    points = points.filter((F.col(ts) >= F.lit(low).cast(kind)) & (F.col(ts) < F.lit(high).cast(kind)))
    levels = sorted(levels) or [0]
    listed = points.withColumn("_level", F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels))))
    return (
        listed.withColumn("_bin", F.floor(micros(ts) / wide.cast("decimal(20,0)")).cast("bigint"))
        .join(binned, [*keys, "_level", "_bin"], "inner")
        .filter((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end)))
        .drop("_level", "_bin")
    )


def outside_blackouts(
    rows: DataFrame, ts: str, centers: DataFrame, center_ts: str, half_seconds: float
) -> DataFrame:
    """Rows whose ``ts`` is farther than ``half_seconds`` from every center
    (both bounds of a window are inside it).

    With bins as wide as half a window, a center in the row's own bin always
    covers it; from the bin before only the latest center can, from the bin
    after only the earliest. So centers shrink to one row per bin and the
    exclusion is an equi-join, however many centers there are.
    """
    half = int(half_seconds * 1_000_000)
    per_bin = (
        centers.filter(F.col(center_ts).isNotNull())
        .select(micros(center_ts).alias("_c"))
        .groupBy(F.floor(F.col("_c") / F.lit(float(half))).cast("bigint").alias("_b"))
        .agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    )
    near = (
        per_bin.select(
            F.inline(
                F.array(
                    F.struct((F.col("_b") - 1).alias("_bin"), F.col("_lo").alias("_after"),
                             F.lit(None).cast("bigint").alias("_before"), F.lit(False).alias("_same")),
                    F.struct(F.col("_b").alias("_bin"), F.lit(None).cast("bigint").alias("_after"),
                             F.lit(None).cast("bigint").alias("_before"), F.lit(True).alias("_same")),
                    F.struct((F.col("_b") + 1).alias("_bin"), F.lit(None).cast("bigint").alias("_after"),
                             F.col("_hi").alias("_before"), F.lit(False).alias("_same")),
                )
            )
        )
        .groupBy("_bin")
        .agg(F.min("_after").alias("_after"), F.max("_before").alias("_before"),
             F.bool_or("_same").alias("_same"))
    )
    at = micros(ts)
    covered = (
        F.coalesce("_same", F.lit(False))
        | F.coalesce(F.col("_after") - at <= half, F.lit(False))
        | F.coalesce(at - F.col("_before") <= half, F.lit(False))
    )
    return (
        rows.withColumn("_bin", F.floor(at / F.lit(float(half))).cast("bigint"))
        .join(near, "_bin", "left")
        .filter(~covered)
        .drop("_bin", "_after", "_before", "_same")
    )
