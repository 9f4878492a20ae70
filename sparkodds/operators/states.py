"""Cross-venue states: as-of assembly, edge, fee, size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkodds.functions.stats import VENUE_A_TAKER, VENUE_B_TAKER, fee
from sparkodds.operators.asof import asof_legs
from sparkodds.operators.books import LEGS
from sparkodds.operators.slices import DEFAULT_SLICE_SECONDS

# Direction labels and the tolerance for an own book that crosses.
BUY_B, BUY_A = "buy_poly", "buy_kalshi"
CROSS_TOLERANCE = 0.0001


def assemble_states(bbo: DataFrame, slice_seconds: float = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """The four legs as of every distinct change time of a game."""
    legs = asof_legs(
        bbo,
        ["game_key"],
        "timestamp",
        ["recv_ts", "id"],
        "update_type",
        LEGS,
        ["price", "size"],
        keep=["game_date"],
        slice_seconds=slice_seconds,
    )
    flat = [c for leg in LEGS for c in (F.col(f"{leg}.price").alias(leg), F.col(f"{leg}.size").alias(f"{leg}_size"))]
    return legs.select("timestamp", "game_key", "game_date", *flat)


def valid_state(tolerance: float = CROSS_TOLERANCE) -> Column:
    """All four prices present and neither own book crossed beyond the tolerance."""
    present = F.lit(True)
    for leg in LEGS:
        present = present & F.col(leg).isNotNull()
    return (
        present
        & (F.col("k_bid") <= F.col("k_ask") + tolerance)
        & (F.col("p_bid") <= F.col("p_ask") + tolerance)
    )


def with_edge(states: DataFrame) -> DataFrame:
    """Spreads, gross edge, direction, taker fees of both legs, tradable size
    and net edge."""
    edge_b = F.col("k_bid") - F.col("p_ask")
    edge_a = F.col("p_bid") - F.col("k_ask")
    take_b = (edge_b >= edge_a) & (edge_b > 0)
    take_a = edge_a > 0
    fee_b = fee("p_ask", VENUE_B_TAKER) + fee("k_bid", VENUE_A_TAKER)
    fee_a = fee("k_ask", VENUE_A_TAKER) + fee("p_bid", VENUE_B_TAKER)
    return states.withColumns(
        {
            "k_spread": F.col("k_ask") - F.col("k_bid"),
            "p_spread": F.col("p_ask") - F.col("p_bid"),
            "gross_arb": F.greatest(F.lit(0.0), edge_b, edge_a),
            "direction": F.when(take_b, BUY_B).when(take_a, BUY_A),
            "total_fee": F.when(take_b, fee_b).when(take_a, fee_a).otherwise(0.0),
            "min_size": F.when(take_b, F.least("p_ask_size", "k_bid_size"))
            .when(take_a, F.least("k_ask_size", "p_bid_size"))
            .otherwise(F.least(*[f"{leg}_size" for leg in LEGS])),
        }
    ).withColumn("net_arb", F.col("gross_arb") - F.col("total_fee"))


def states(bbo: DataFrame, slice_seconds: float = DEFAULT_SLICE_SECONDS) -> DataFrame:
    return with_edge(assemble_states(bbo, slice_seconds).filter(valid_state()))


def time_slice_of_game(states_df: DataFrame, game: str, start: str, end: str) -> DataFrame:
    """One game's states between two times, both included, in order."""
    return states_df.filter(
        (F.col("game_key") == game)
        & F.col("timestamp").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    ).orderBy("timestamp")
