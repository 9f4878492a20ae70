"""Incremental landing: what to fetch next, from what is already stored."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.functions.timefn import iso_to_utc, micros, month_ranges, seconds
from sparkodds.operators.latest import keep_last, not_in

# First schedule day, look-ahead, retry age, overlap, game types.
SCHEDULE_START = date(2025, 4, 16)
LOOK_AHEAD_DAYS = 10
RETRY_NOT_FOUND_DAYS = 14
OVERLAP_SECONDS = 1
GAME_TYPES = ["R", "F", "D", "L", "W"]


def schedule_ranges(spark: SparkSession, today: date, start: date = SCHEDULE_START) -> DataFrame:
    """Month ranges from the first day to a few days ahead, so that listed
    upcoming games can be mapped."""
    bounds = spark.range(1).select(
        F.lit(start).alias("lo"), F.lit(today + timedelta(days=LOOK_AHEAD_DAYS)).alias("hi")
    )
    return month_ranges(bounds)


def last_event_times(trades: DataFrame) -> DataFrame:
    """Newest stored time per market."""
    return trades.groupBy("ticker").agg(iso_to_utc(F.max("created_time")).alias("last_time"))


def trade_plan(markets: DataFrame, trades: DataFrame, done: DataFrame, cutoff: str) -> DataFrame:
    """Markets still to fetch: where to resume, and whether the historical and the
    live part are needed (a market may need both; unknown times need both)."""
    at = F.lit(cutoff)
    start = F.coalesce("last_time", iso_to_utc("open_time"))
    close = iso_to_utc("close_time")
    edge = iso_to_utc(at)
    return (
        not_in(markets, done, "ticker")
        .join(last_event_times(trades), "ticker", "left")
        .select(
            "ticker",
            (F.floor(micros("last_time") / F.lit(1e6)) - OVERLAP_SECONDS).cast("bigint").alias("min_ts"),
            F.coalesce(start < edge, F.lit(True)).alias("historical"),
            F.coalesce(close >= edge, F.lit(True)).alias("live"),
        )
    )


def new_trades(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming trades from each market's resume point on; the overlap repeats
    some stored rows, which the keyed upsert removes."""
    resume = last_event_times(stored)
    return (
        incoming.join(resume, "ticker", "left")
        .filter(
            F.col("last_time").isNull()
            | (iso_to_utc("created_time") >= F.col("last_time") - seconds(OVERLAP_SECONDS))
        )
        .drop("last_time")
    )


def completed(markets: DataFrame) -> DataFrame:
    """Markets to mark as fully pulled, to be written after all of a run's data."""
    return markets.filter(F.col("status") == "finalized").select("ticker")


PHASES = ["historical", "live"]


def run_phases(plan: DataFrame) -> DataFrame:
    """(ticker, phase, min_ts): the parts of a run that ``trade_plan`` asks for."""
    wanted = F.filter(
        F.array(*(F.struct(F.lit(p).alias("phase"), F.col(p).alias("wanted")) for p in PHASES)), lambda x: x["wanted"]
    )
    return plan.select("ticker", "min_ts", F.explode(wanted).alias("x")).select("ticker", F.col("x.phase").alias("phase"), "min_ts")


def run_states(planned: DataFrame, pages: DataFrame) -> DataFrame:
    """(ticker, phase, n_pages, state) of every planned part, by the pages that have
    arrived, (ticker, phase, page, is_last) numbered from 1: ``complete`` if the
    last page is there and none before it is missing, ``landed`` if some are,
    ``planned`` if none is. Pages that arrive twice count once; a market without
    trades has one page, an empty last one. Pages that nobody asked for are left
    out."""
    arrived = pages.groupBy("ticker", "phase").agg(
        F.countDistinct("page").alias("n_pages"), F.max(F.when(F.col("is_last"), F.col("page"))).alias("_last"), F.max("page").alias("_top")
    )
    whole = (F.col("_top") == F.col("_last")) & (F.col("n_pages") == F.col("_last"))
    state = F.when(F.col("n_pages").isNull(), "planned").when(whole, "complete").otherwise("landed")
    return planned.select("ticker", "phase").join(arrived, ["ticker", "phase"], "left").select(
        "ticker", "phase", F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("n_pages"), state.alias("state")
    )


def completed_in_run(states: DataFrame, markets: DataFrame) -> DataFrame:
    """Finalized markets of which every planned part is complete."""
    whole = states.groupBy("ticker").agg(F.bool_and(F.col("state") == "complete").alias("_whole")).filter("_whole")
    return completed(markets).join(whole, "ticker", "left_semi")


def game_worklist(games: DataFrame, pulls: DataFrame, today: date) -> DataFrame:
    """Final games never pulled, or not found but recent enough to try again, by date."""
    floor = (today - timedelta(days=RETRY_NOT_FOUND_DAYS)).isoformat()
    retry = F.col("not_found") & (F.col("game_date") >= floor)
    return (
        games.filter(F.col("coded_game_state") == "F").select("game_pk", "game_date")
        .join(pulls.select("game_pk", "not_found"), "game_pk", "left")
        .filter(F.col("not_found").isNull() | retry)
        .select("game_pk", "game_date")
        .orderBy("game_date", "game_pk")
    )


def schedule_games(flat: DataFrame, order: Column | str) -> DataFrame:
    """Games of the counted types, one row per game: a rescheduled game appears on
    two dates and the last listing wins."""
    return keep_last(flat.filter(F.col("game_type").isin(*GAME_TYPES)), ["game_pk"], [order])


def subscriptions(matched: DataFrame, game_date: str) -> DataFrame:
    """Distinct tickers and slugs of one day's pairs, in first-seen order."""
    day = matched.filter(F.col("game_date") == F.lit(game_date).cast("date"))
    ids = F.array(
        F.struct(F.lit("kalshi").alias("platform"), F.col("kalshi_ticker_away").alias("market_id"), F.lit(0).alias("i")),
        F.struct(F.lit("kalshi").alias("platform"), F.col("kalshi_ticker_home").alias("market_id"), F.lit(1).alias("i")),
        F.struct(F.lit("polymarket").alias("platform"), F.col("poly_slug").alias("market_id"), F.lit(2).alias("i")),
    )
    return (
        day.select("id", F.inline(ids))
        .groupBy("platform", "market_id")
        .agg(F.min(F.struct("id", "i")).alias("_seen"))
        .orderBy("_seen")
        .select("platform", "market_id")
    )
