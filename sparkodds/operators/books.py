"""Top of book from stored snapshots, and change detection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparkodds.functions.books import complement, levels, top_of
from sparkodds.functions.tickers import game_key
from sparkodds.functions.timefn import epoch_ms_to_utc, iso_to_utc
from sparkodds.operators.slices import DEFAULT_SLICE_SECONDS, previous_row

# Platform and side names in the stored snapshots, leg names.
VENUE_A, VENUE_B = "kalshi", "polymarket"
LEGS = ["k_bid", "k_ask", "p_bid", "p_ask"]
BOOK_LEGS = [
    # platform, side, leg, end of the stored book that is best, invert the price
    (VENUE_A, "yes", "k_bid", "last", False),
    (VENUE_A, "no", "k_ask", "last", True),
    (VENUE_B, "bids", "p_bid", "first", False),
    (VENUE_B, "offers", "p_ask", "first", False),
]


def book_dimension(matched: DataFrame, key: str = "game_key") -> DataFrame:
    """Matched pairs unpivoted to (platform, market_id, side) → (game, leg), so
    the snapshots need one join instead of one per leg.

    ``key='event'`` keys games by their event ticker, which keeps the two games
    of a doubleheader apart; ``'game_key'`` uses away@home-date.
    """
    game = (
        game_key("away_team", "home_team", "game_date") if key == "game_key" else F.col("kalshi_event_ticker")
    )
    legs = F.array(
        *[
            F.struct(
                F.lit(platform).alias("platform"),
                (F.col("kalshi_ticker_away") if platform == VENUE_A else F.col("poly_slug")).alias("market_id"),
                F.lit(side).alias("side"),
                F.lit(leg).alias("update_type"),
            )
            for platform, side, leg, _, _ in BOOK_LEGS
        ]
    )
    return matched.select(game.alias("game_key"), "game_date", F.inline(legs))


def source_time() -> Column:
    """Exchange time of a stored snapshot: epoch milliseconds or ISO text, by platform."""
    return F.when(F.col("platform") == VENUE_A, epoch_ms_to_utc("source_timestamp")).otherwise(
        iso_to_utc("source_timestamp")
    )


STORED = ["id", "timestamp", "platform", "market_id", "side", "book_json", "source_timestamp"]


def quotes(snapshots: DataFrame, matched: DataFrame, key: str = "game_key", seen: Observation | None = None) -> DataFrame:
    """Best price and size of every stored book side, on exchange time.

    An empty side is a row with NULL price and size. Rows without a readable
    source time are dropped; ``missing_source_time`` counts them, and so does
    ``seen``, in the pass that writes the quotes (n_snapshots, n_missing).
    """
    timed = snapshots.select(*STORED, source_time().alias("_event_ts"))
    if seen is not None:
        timed = timed.observe(
            seen, F.count(F.lit(1)).alias("n_snapshots"), F.count_if(F.col("_event_ts").isNull()).alias("n_missing")
        )
    price = F.when(F.col("update_type") == "k_ask", complement("_top.price")).otherwise(F.col("_top.price"))
    return (
        timed.filter(F.col("_event_ts").isNotNull())
        .join(book_dimension(matched, key), ["platform", "market_id", "side"])
        # a step of its own, so that each book is parsed once
        .withColumn("_levels", levels("book_json"))
        .withColumn("_top", top_of("_levels", F.col("platform") == VENUE_A))
        .select(
            F.col("_event_ts").alias("timestamp"),
            F.col("timestamp").alias("recv_ts"),
            "id",
            "game_key",
            "game_date",
            "update_type",
            price.alias("price"),
            F.col("_top.size").alias("size"),
        )
    )


def missing_source_time(snapshots: DataFrame, since: date | str) -> DataFrame:
    return snapshots.filter(
        source_time().isNull() & (F.col("timestamp") >= F.lit(str(since)).cast("timestamp_ntz"))
    ).agg(F.count(F.lit(1)).alias("n_missing"))


def bbo_changes(
    quotes_df: DataFrame,
    since: date | str | None = None,
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """Quotes that change the top of the book: a leg's first row, and any change
    of price or size, NULL (an emptied side) included.

    The cutoff is applied before looking back, so the first row after it counts
    as first. Order within a leg: event time, receive time, id.
    """
    rows = quotes_df
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= F.lit(str(since)).cast("timestamp_ntz"))
    compared = previous_row(
        rows,
        ["game_key", "update_type"],
        "timestamp",
        ["timestamp", "recv_ts", "id"],
        ["price", "size"],
        "_prev",
        slice_seconds,
    )
    changed = (
        F.col("_prev").isNull()
        | ~F.col("price").eqNullSafe(F.col("_prev.price"))
        | ~F.col("size").eqNullSafe(F.col("_prev.size"))
    )
    return compared.filter(changed).drop("_prev")
