"""Typed views over raw tables: times to TIMESTAMP_NTZ, prices and counts to DECIMAL(18,6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.functions.timefn import iso_to_utc

DECIMAL = "decimal(18,6)"


def cast_columns(
    df: DataFrame, times: tuple[str, ...] = (), decimals: tuple[str, ...] = (), dates: tuple[str, ...] = ()
) -> DataFrame:
    """Replace the named columns by their typed form and keep the rest."""
    return df.withColumns(
        {
            **{c: iso_to_utc(c) for c in times},
            **{c: F.col(c).cast(DECIMAL) for c in decimals},
            **{c: F.col(c).cast("date") for c in dates},
        }
    )


def markets_typed(markets: DataFrame) -> DataFrame:
    return cast_columns(
        markets,
        times=("open_time", "close_time", "settlement_ts"),
        decimals=("settlement_value_dollars", "volume_fp", "open_interest_fp"),
    )


def trades_typed(trades: DataFrame) -> DataFrame:
    return cast_columns(
        trades, times=("created_time",), decimals=("count_fp", "yes_price_dollars", "no_price_dollars")
    )


def games_typed(games: DataFrame) -> DataFrame:
    return cast_columns(games, times=("game_date",), dates=("official_date",))


def plays_typed(plays: DataFrame) -> DataFrame:
    return cast_columns(plays, times=("start_time", "end_time"))


def win_probability_typed(wp: DataFrame) -> DataFrame:
    return cast_columns(wp, times=("play_end_time",))


VIEWS = {
    "markets": markets_typed,
    "trades": trades_typed,
    "mlb_games": games_typed,
    "mlb_plays": plays_typed,
    "mlb_win_probability": win_probability_typed,
}


def register_views(tables: dict[str, DataFrame]) -> None:
    """Temp views ``<table>`` and, where one is defined, ``<table>_typed``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
        if name in VIEWS:
            VIEWS[name](df).createOrReplaceTempView(f"{name}_typed")


def ask(spark: SparkSession, text: str, values: dict[str, object] | None = None, **frames: DataFrame) -> DataFrame:
    """A SQL text over frames, named in it as ``{name}``, with ``:name`` parameters.
    Values reach Spark as literals of their own and never become part of the text."""
    return spark.sql(text, values, **frames)
