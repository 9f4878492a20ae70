"""Contiguous crossed-price episodes, their metrics and blackout exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkodds.functions.timefn import elapsed_seconds, wall_to_utc
from sparkodds.operators.intervals import outside_blackouts
from sparkodds.operators.slices import (
    DEFAULT_SLICE_SECONDS,
    earlier,
    row_numbers,
    sliced_scan,
    so_far,
)
from sparkodds.operators.snapshots import one_row
from sparkodds.operators.states import BUY_A, BUY_B
from sparkodds.session import materialize

BLACKOUT_SECONDS = 30


def raw_episodes(states: DataFrame, slice_seconds: float = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """One row per maximal run of states with a positive gross edge.

    A run is named by the last edge-free time before it, so runs need no
    numbering and no look at the previous row across tasks. The row after a run
    is its first later edge-free state, hence its end; a run that lasts to the
    end of the data ends at its last state. Runs are aggregated (combined
    map-side), so one endless run is no bottleneck. Averages are per state, not
    time-weighted; a run with both directions reports the text-greater one.
    """
    flat = F.when(F.col("gross_arb") <= 0, F.col("timestamp"))
    scanned = sliced_scan(
        states,
        ["game_key"],
        "timestamp",
        ["timestamp"],
        local={
            "_flat": lambda w: F.max(flat).over(so_far(w)),
            "_next": lambda w: F.lead("timestamp").over(w),
        },
        tail={"_tail_flat": F.max(flat), "_first": F.min("timestamp")},
        carry={
            "_before_flat": earlier("_tail_flat", F.max),
            "_next_first": lambda w: F.lead("_first").over(w),
        },
        slice_seconds=slice_seconds,
    )
    edge = (
        scanned.filter(F.col("gross_arb") > 0)
        .withColumn("_run", F.coalesce("_flat", "_before_flat"))
        .withColumn("_after", F.coalesce("_next", "_next_first"))
    )
    late, early = max(BUY_A, BUY_B), min(BUY_A, BUY_B)
    return (
        edge.groupBy("game_key", "game_date", "_run")
        .agg(
            F.min("timestamp").alias("start_ts"),
            F.max("timestamp").alias("_last"),
            F.max("_after").alias("_close"),
            F.max("gross_arb").alias("max_gross_arb"),
            F.avg("gross_arb").alias("avg_gross_arb"),
            F.max("net_arb").alias("max_net_arb"),
            F.avg("net_arb").alias("avg_net_arb"),
            F.bool_or(F.col("direction") == late).alias("_late"),
            F.count(F.lit(1)).alias("n_states"),
            F.min("min_size").alias("bottleneck_liquidity"),
            F.avg("total_fee").alias("avg_fee"),
        )
        # the maximum is the row after the run; without one it falls back to the run's last row
        .withColumn("end_ts", F.greatest("_close", "_last"))
        .select(
            "game_key",
            "game_date",
            "start_ts",
            "end_ts",
            elapsed_seconds("start_ts", "end_ts").alias("duration_s"),
            "max_gross_arb",
            "avg_gross_arb",
            "max_net_arb",
            "avg_net_arb",
            F.when(F.col("_late"), late).otherwise(early).alias("direction"),
            "n_states",
            "bottleneck_liquidity",
            "avg_fee",
        )
    )


def blackout_centers(metadata: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """UTC times of collector starts and reconnects (logged in local wall time)."""
    return metadata.filter(F.col("event").isin("start", "reconnect")).select(
        wall_to_utc("timestamp", zone).alias("center_ts")
    )


def episodes(
    states: DataFrame,
    metadata: DataFrame | None = None,
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
    blackout_seconds: float = BLACKOUT_SECONDS,
    number: bool = True,
) -> DataFrame:
    """Episodes outside blackouts, numbered by (start, game)."""
    found = raw_episodes(states, slice_seconds)
    if metadata is not None:
        found = outside_blackouts(found, "start_ts", blackout_centers(metadata), "center_ts", blackout_seconds)
    if not number:
        return found
    # numbering reads its input twice
    return row_numbers(materialize(found), [], "start_ts", ["start_ts", "game_key"], "episode_id", 24 * slice_seconds)


def duration_buckets(eps: DataFrame) -> DataFrame:
    d = F.col("duration_s")
    return eps.agg(
        F.count_if(d < 1).alias("under_1s"),
        F.count_if((d >= 1) & (d < 2)).alias("s1"),
        F.count_if((d >= 2) & (d < 3)).alias("s2"),
        F.count_if((d >= 3) & (d < 5)).alias("s3_5"),
        F.count_if((d >= 5) & (d < 10)).alias("s5_10"),
        F.count_if(d >= 10).alias("s10p"),
    )


def per_game(eps: DataFrame) -> DataFrame:
    return eps.groupBy("game_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("max_net_arb") > 0).alias("n_net")
    )


def build_info(bbo: DataFrame, states: DataFrame, eps: DataFrame) -> DataFrame:
    """One row of dataset metadata (``built_at`` is added on write)."""
    return one_row(
        states.agg(
            F.min("timestamp").cast("date").alias("data_start"),
            F.max("timestamp").cast("date").alias("data_end"),
            F.countDistinct("game_key").alias("n_games"),
            F.count(F.lit(1)).alias("n_states"),
            F.count_if(F.col("gross_arb") > 0).alias("n_arb_states"),
        ),
        bbo.agg(F.count(F.lit(1)).alias("n_bbo_changes")),
        eps.agg(
            F.count(F.lit(1)).alias("n_episodes"),
            F.count_if(F.col("max_net_arb") > 0).alias("n_profitable"),
        ),
    )
