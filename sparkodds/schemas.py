"""Table and payload schemas. Raw tables keep prices and times as the text received."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables as (DDL, key columns, required columns beyond the key).
TABLES: dict[str, tuple[str, list[str], list[str]]] = {
    "events": (
        "event_ticker string, series_ticker string, title string, category string, sub_title string",
        ["event_ticker"],
        ["series_ticker"],
    ),
    "markets": (
        "ticker string, event_ticker string, market_type string, yes_sub_title string, no_sub_title string,"
        " status string, result string, open_time string, close_time string, settlement_ts string,"
        " settlement_value_dollars string, volume_fp string, open_interest_fp string, rules_primary string",
        ["ticker"],
        ["event_ticker", "status"],
    ),
    "trades": (
        "trade_id string, ticker string, count_fp string, yes_price_dollars string, no_price_dollars string,"
        " taker_outcome_side string, taker_book_side string, created_time string, is_block_trade boolean",
        ["trade_id"],
        ["ticker", "is_block_trade"],
    ),
    "kalshi_trade_pulls": ("ticker string", ["ticker"], []),
    "mlb_games": (
        "game_pk bigint, game_type string, game_date string, official_date string, coded_game_state string,"
        " detailed_state string, away_team_id int, away_team_name string, away_score int, away_is_winner boolean,"
        " home_team_id int, home_team_name string, home_score int, home_is_winner boolean, venue_id int,"
        " venue_name string, double_header string, game_number int, day_night string",
        ["game_pk"],
        ["game_type", "game_date", "official_date"],
    ),
    "mlb_plays": (
        "game_pk bigint, at_bat_index int, inning int, half_inning string, start_time string, end_time string,"
        " event string, away_score int, home_score int, is_scoring_play boolean",
        ["game_pk", "at_bat_index"],
        [],
    ),
    "mlb_win_probability": (
        "game_pk bigint, at_bat_index int, home_wp double, away_wp double, home_wp_added double, play_end_time string",
        ["game_pk", "at_bat_index"],
        [],
    ),
    "mlb_weather": ("game_pk bigint, condition string, temp string, wind string", ["game_pk"], []),
    "mlb_game_pulls": ("game_pk bigint, not_found boolean", ["game_pk"], ["not_found"]),
    "kalshi_mlb_map": (
        "event_ticker string, game_pk bigint, away_abbr string, home_abbr string, away_team_id int,"
        " home_team_id int, ticker_start_utc string, orientation_ok boolean, start_delta_minutes double,"
        " match_method string",
        ["event_ticker"],
        ["game_pk", "away_abbr", "home_abbr", "away_team_id", "home_team_id", "orientation_ok", "match_method"],
    ),
    "matched_markets": (
        "id bigint, game_date date, away_team string, home_team string, kalshi_ticker_away string,"
        " kalshi_ticker_home string, poly_slug string, kalshi_event_ticker string, poly_event_slug string",
        ["id"],
        ["game_date", "away_team", "home_team", "kalshi_ticker_away", "kalshi_ticker_home", "poly_slug",
         "kalshi_event_ticker", "poly_event_slug"],
    ),
    "orderbook_snapshots": (
        "id bigint, timestamp timestamp_ntz, platform string, market_id string, side string, book_json string,"
        " source_timestamp string",
        ["id"],
        ["timestamp", "platform", "market_id", "side", "book_json"],
    ),
    "collection_metadata": (
        "id bigint, event string, platform string, timestamp timestamp_ntz, details string",
        ["id"],
        ["event", "platform", "timestamp"],
    ),
}

# Nested payloads, with the names they arrive under.
EVENT_PAGE = "events array<struct<event_ticker string, series_ticker string, title string, category string, sub_title string>>, cursor string"
EVENT_LOOKUP = "event struct<event_ticker string, series_ticker string, title string, category string, sub_title string>"
MARKET_PAGE = (
    "markets array<struct<ticker string, event_ticker string, market_type string, yes_sub_title string,"
    " no_sub_title string, status string, result string, open_time string, close_time string, settlement_ts string,"
    " settlement_value_dollars string, volume_fp string, open_interest_fp string, rules_primary string>>, cursor string"
)
TRADE_PAGE = (
    "trades array<struct<trade_id string, ticker string, count_fp string, yes_price_dollars string,"
    " no_price_dollars string, taker_outcome_side string, taker_book_side string, created_time string,"
    " is_block_trade boolean>>, cursor string"
)
_SIDE = "struct<team struct<id int, name string>, score int, isWinner boolean>"
SCHEDULE = (
    "dates array<struct<date string, games array<struct<gamePk bigint, gameType string, gameDate string,"
    " officialDate string, status struct<codedGameState string, detailedState string>,"
    f" teams struct<away {_SIDE}, home {_SIDE}>, venue struct<id int, name string>, doubleHeader string,"
    " gameNumber int, dayNight string>>>>"
)
PLAY_BY_PLAY = (
    "allPlays array<struct<about struct<atBatIndex int, halfInning string, inning int, startTime string,"
    " endTime string, isScoringPlay boolean>, result struct<event string, awayScore int, homeScore int>>>"
)
WIN_PROBABILITY = (
    "array<struct<atBatIndex int, homeTeamWinProbability double, awayTeamWinProbability double,"
    " homeTeamWinProbabilityAdded double, playEndTime string>>"
)
LIVE_FEED = "gameData struct<weather struct<condition string, temp string, wind string>>"
LEAGUE_EVENTS = (
    "events array<struct<id string, slug string, title string, startDate string, endDate string, active boolean,"
    " closed boolean, live boolean, ended boolean, markets array<struct<id string, slug string, question string,"
    " sportsMarketType string, marketType string, marketSides array<struct<id string, description string,"
    " teamId int, team struct<id int, name string, abbreviation string, league string,"
    " displayAbbreviation string, ordering string>, identifier string, `long` boolean>>, active boolean,"
    " closed boolean, gameStartTime string, endDate string>>>>"
)
BOOK_MESSAGE = (
    "type string, msg struct<market_ticker string, ts_ms bigint, yes_dollars_fp array<array<string>>,"
    " no_dollars_fp array<array<string>>, side string, price_dollars string, delta_fp string>"
)
FULL_BOOK_MESSAGE = (
    "heartbeat string, marketData struct<marketSlug string, transactTime string,"
    " bids array<struct<px struct<value string>, qty string>>, offers array<struct<px struct<value string>, qty string>>>"
)

_GAME = "dates[].games[]"
_TEAMS = [f"{_GAME}.teams.{side}{part}" for side in ("away", "home") for part in ("", ".team", ".team.id", ".team.name")]

# The schema of each payload and the fields that it must have, at any
# depth; ``[]`` stands for every item of a list, and alone at the end for the item itself.
PAYLOADS = {
    "schedule": (
        SCHEDULE,
        ["dates", "dates[]", "dates[].date", "dates[].games", _GAME]
        + [f"{_GAME}.{c}" for c in ("gamePk", "gameType", "gameDate", "officialDate", "status", "status.codedGameState", "status.detailedState")]
        + [f"{_GAME}.teams", *_TEAMS, *(f"{_GAME}.{c}" for c in ("venue", "doubleHeader", "gameNumber"))],
    ),
    "play_by_play": (
        PLAY_BY_PLAY,
        ["allPlays", "allPlays[]"] + [f"allPlays[].{c}" for c in ("about", "about.atBatIndex", "about.halfInning", "about.inning", "result")],
    ),
}


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def table_schema(name: str) -> T.StructType:
    ddl, key, required = TABLES[name]
    schema = struct_type(ddl)
    for field in schema.fields:
        field.nullable = field.name not in key and field.name not in required
    return schema


def required_columns(name: str) -> list[str]:
    _, key, required = TABLES[name]
    return [*key, *required]


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def snake_type(t: T.DataType) -> T.DataType:
    """The same type with every field name in snake case."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(snake(f.name), snake_type(f.dataType), True) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(snake_type(t.elementType), t.containsNull)
    return t


def snake_columns(df: DataFrame) -> DataFrame:
    """Rename columns and nested fields to snake case; a cast between structs
    goes by position, so this costs nothing at run time."""
    return df.select(
        *[F.col(f"`{f.name}`").cast(snake_type(f.dataType)).alias(snake(f.name)) for f in df.schema.fields]
    )


def conformed(df: DataFrame, name: str) -> list[Column]:
    """Columns of a registered table, matched by name and cast; absent ones are NULL."""
    out: list[Column] = []
    for field in table_schema(name).fields:
        source = F.col(field.name) if field.name in df.columns else F.lit(None)
        out.append(source.cast(field.dataType).alias(field.name))
    return out


def conform(df: DataFrame, name: str) -> DataFrame:
    return df.select(*conformed(df, name))


def create_table(spark: SparkSession, name: str, path: str | None = None) -> None:
    """Create an empty table unless it exists."""
    if not spark.catalog.tableExists(name):
        writer = spark.createDataFrame([], table_schema(name)).write.format("parquet")
        if path:
            writer = writer.option("path", path)
        writer.saveAsTable(name)


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns a stored table lacks, as NULLs of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
