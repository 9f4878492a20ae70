"""Ordered scans (previous row, carry-forward, numbering) that split a hot key.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole key into one task,
so one key with a third of all rows stops the job. Here every key is cut into
fixed time slices and the window runs per (key, slice):

1. *local*: the window within the slice. One shuffle on (key, slice).
2. *tail*: what a slice hands on, as an aggregate: one row per (key, slice),
   combined map-side before its (small) shuffle.
3. *carry*: a window over the tails of one key. A key has at most
   time range / slice width tails, whatever its row count.
4. The carry joins back on (key, slice), the partitioning the local window
   already has.

Results do not depend on the slice width; it only trades tails against the
largest task. Timestamps have microsecond grain, rows that tie on a timestamp
stay in one slice.

The input is read twice (tails and rows): pass a table or a materialized frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sparkodds.functions.timefn import col, time_slice

SLICE = "_slice"
DEFAULT_SLICE_SECONDS = 3600.0

Over = Callable[[WindowSpec], Column]


def _partition(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys) if keys else Window.partitionBy()


def sliced_scan(
    df: DataFrame,
    keys: Sequence[str],
    ts: Column | str,
    order: Sequence[Column | str],
    local: dict[str, Over],
    tail: dict[str, Column],
    carry: dict[str, Over],
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """``df`` plus the ``local`` and ``carry`` columns and ``_slice``.

    ``local`` gets the window of one (key, slice) in ``order``; ``tail`` are
    aggregates of a slice; ``carry`` gets the window over a key's tails in slice
    order. Rows with a NULL key or time have no place in an order and are left out.
    """
    keys = list(keys)
    rows = df.withColumn(SLICE, time_slice(ts, slice_seconds))
    tails = rows.groupBy(*keys, SLICE).agg(*[agg.alias(name) for name, agg in tail.items()])
    by_key = _partition(keys).orderBy(SLICE)
    carried = tails.select(*keys, SLICE, *[fn(by_key).alias(name) for name, fn in carry.items()])
    in_slice = _partition([*keys, SLICE]).orderBy(*[col(c) for c in order])
    scanned = rows.withColumns({name: fn(in_slice) for name, fn in local.items()})
    return scanned.join(carried, [*keys, SLICE], "inner")


def earlier(name: str, how: Callable[[Column], Column]) -> Over:
    """Carry: ``how`` over the tails of all earlier slices."""
    return lambda w: how(F.col(name)).over(w.rowsBetween(Window.unboundedPreceding, -1))


def so_far(w: WindowSpec) -> WindowSpec:
    """Frame from the slice's first row to the current one."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_known(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    values: Sequence[str],
    out: str = "prev",
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Add struct ``out`` with the previous row's ``values`` (NULL on a key's
    first row). ``order`` must be unique within a key to be deterministic."""
    value = F.struct(*values)
    scanned = sliced_scan(
        df,
        keys,
        ts,
        order,
        local={"_local": lambda w: F.lag(value).over(w)},
        tail={"_tail": F.max_by(value, F.struct(*order))},
        carry={"_carry": lambda w: F.lag("_tail").over(w)},
        slice_seconds=slice_seconds,
    )
    return scanned.withColumn(out, F.coalesce("_local", "_carry")).drop("_local", "_carry", SLICE)


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    out: str,
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Dense 1..n numbering in ``order``, over the whole frame when ``keys`` is
    empty. No task sees more than one slice or the list of slice counts."""
    scanned = sliced_scan(
        df,
        keys,
        ts,
        order,
        local={"_local": lambda w: F.row_number().over(w).cast("bigint")},
        tail={"_n": F.count(F.lit(1))},
        carry={"_before": earlier("_n", F.sum)},
        slice_seconds=slice_seconds,
    )
    number = F.col("_local") + F.coalesce("_before", F.lit(0))
    return scanned.withColumn(out, number).drop("_local", "_before", SLICE)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    value: Column | str,
    out: str,
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Cumulative sum in ``order``, current row included."""
    scanned = sliced_scan(
        df.withColumn("_v", col(value)),
        keys,
        ts,
        order,
        local={"_local": lambda w: F.sum("_v").over(so_far(w))},
        tail={"_total": F.sum("_v")},
        carry={"_before": earlier("_total", F.sum)},
        slice_seconds=slice_seconds,
    )
    total = F.coalesce("_local", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return scanned.withColumn(out, total).drop("_v", "_local", "_before", SLICE)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    values: dict[str, Column],
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """For every name in ``values``, the latest non-NULL value up to and
    including the current row. A struct with NULL fields counts as a value."""
    staged = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    position = F.struct(*order)
    scanned = sliced_scan(
        staged,
        keys,
        ts,
        order,
        local={f"_l_{n}": (lambda w, n=n: last_known(F.col(f"_v_{n}")).over(so_far(w))) for n in values},
        tail={
            f"_t_{n}": F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position))
            for n in values
        },
        carry={f"_c_{n}": earlier(f"_t_{n}", last_known) for n in values},
        slice_seconds=slice_seconds,
    )
    return scanned.withColumns(
        {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in values}
    ).drop(SLICE, *[f"_{k}_{n}" for n in values for k in "vlc"])
