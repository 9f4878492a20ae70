"""As-of joins by union and carry-forward: one shuffle, no pairs emitted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkodds.operators.slices import (
    DEFAULT_SLICE_SECONDS,
    carry_forward,
    earlier,
    last_known,
    sliced_scan,
    so_far,
)
from sparkodds.operators.unions import union


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    tie: Sequence[str] = (),
    how: str = "inner",
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Every left row with the latest right row of the same key at or before it.

    Among right rows at one time the last in ``tie`` order wins. A matched row
    whose values are NULL is still a match; ``how='inner'`` drops left rows with
    no match, ``'left'`` keeps them, those with a NULL key or time among them.
    """
    l = left.select(
        *[F.col(k) for k in keys],
        F.col(left_ts).alias("_ts"),
        F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_left"),
    )
    r = right.select(
        *[F.col(k) for k in keys],
        F.col(right_ts).alias("_ts"),
        F.lit(0).alias("_side"),
        F.struct(*values).alias("_right"),
        *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)],
    )
    rows = union(l, r, missing=True)
    order = ["_ts", "_side", *[f"_tie{i}" for i in range(len(tie))]]
    filled = carry_forward(
        rows, keys, "_ts", order, {"_match": F.col("_right")}, slice_seconds=slice_seconds
    ).filter("_side = 1")
    if how == "inner":
        filled = filled.filter("_match IS NOT NULL")
    found = filled.select("_left", "_match")
    if how == "left":
        placed = F.col("_ts").isNotNull()
        for k in keys:
            placed = placed & F.col(k).isNotNull()
        found = union(found, l.filter(~placed).select("_left"), missing=True)
    return found.select("_left.*", *[F.col(f"_match.{v}").alias(v) for v in values])


def asof_legs(
    updates: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    leg: str,
    legs: Sequence[str],
    values: Sequence[str],
    keep: Sequence[str] = (),
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """One row per distinct (keys, ts) with each leg's latest ``values`` struct
    as of then, where every leg has been seen.

    Equals as many inner as-of joins as there are legs against the distinct
    times, in a single shuffle. Ties at one time resolve to the last row in
    ``tie`` order. A NULL quote is carried like any other.
    """
    order = [ts, *tie]
    value, position = F.struct(*values), F.struct(*order)
    scanned = sliced_scan(
        updates,
        keys,
        ts,
        order,
        local={
            **{
                f"_l_{n}": (lambda w, n=n: last_known(F.when(F.col(leg) == n, value)).over(so_far(w)))
                for n in legs
            },
            "_next": lambda w: F.lead(ts).over(w),
        },
        tail={
            f"_t_{n}": F.max_by(F.when(F.col(leg) == n, value), F.when(F.col(leg) == n, position))
            for n in legs
        },
        carry={f"_c_{n}": earlier(f"_t_{n}", last_known) for n in legs},
        slice_seconds=slice_seconds,
    )
    # rows tied on ts share a slice, so the group's last row is seen locally
    last_of_time = F.col("_next").isNull() | (F.col("_next") != F.col(ts))
    state = scanned.filter(last_of_time).select(
        *keys, *keep, ts, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in legs]
    )
    return state.dropna(subset=list(legs))
