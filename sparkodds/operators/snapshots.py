"""Market universe, point-in-time and per-interval price snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkodds.functions.stats import cents, wind_mph
from sparkodds.functions.tickers import market_suffix
from sparkodds.functions.timefn import iso_to_utc, seconds
from sparkodds.operators.intervals import interval_join
from sparkodds.operators.unions import union

# Label corrections and labels of the exhibition events.
LABEL_FIXES = {"Chicago W": "Chicago WS"}
EXHIBITION_LABELS = ["AL", "NL"]


def label_fix(c: str, fixes: dict[str, str] = LABEL_FIXES) -> Column:
    expr = F.col(c)
    for wrong, right in fixes.items():
        expr = F.when(F.col(c) == wrong, right).otherwise(expr)
    return expr


def universe(markets: DataFrame) -> DataFrame:
    """Markets that settled yes or no, exhibition events left out."""
    return markets.filter(
        (F.col("status") == "finalized")
        & (F.col("market_type") == "binary")
        & F.col("result").isin("yes", "no")
        & ~F.coalesce("yes_sub_title", F.lit("")).isin(*EXHIBITION_LABELS)
    ).select(
        "ticker",
        "event_ticker",
        label_fix("yes_sub_title").alias("team"),
        (F.col("result") == "yes").cast("int").alias("y"),
        market_suffix("ticker").alias("yes_abbr"),
    )


def market_context(universe_df: DataFrame, event_map: DataFrame, games: DataFrame) -> DataFrame:
    """Universe with game, side and scheduled start: the ticker's start where it
    has one, else the schedule's."""
    mapped = event_map.select("event_ticker", "game_pk", "home_abbr", "ticker_start_utc")
    scheduled = games.select("game_pk", "game_date")
    return (
        universe_df.join(mapped, "event_ticker")
        .join(scheduled, "game_pk")
        .select(
            "ticker",
            "event_ticker",
            "team",
            "y",
            "game_pk",
            F.when(F.col("yes_abbr") == F.col("home_abbr"), "home").otherwise("away").alias("side"),
            F.coalesce(iso_to_utc("ticker_start_utc"), F.col("game_date")).alias("sched_start"),
        )
    )


def interval_starts(plays: DataFrame) -> DataFrame:
    """First start time per (game, inning)."""
    return plays.groupBy("game_pk", "inning").agg(F.min("start_time").alias("inning_start"))


def pre_window_trades(trades: DataFrame, context: DataFrame, hours: float = 24, bin_hours: float = 4) -> DataFrame:
    """Every trade in the half-open window of ``hours`` before its market's start."""
    return window_trades(window_prints(trades, context, hours, bin_hours))


def window_prints(trades: DataFrame, context: DataFrame, hours: float = 24, bin_hours: float = 4) -> DataFrame:
    """The trades of ``pre_window_trades`` with their cents. ``window_trades`` and
    ``snapshots_at_start`` both read them, so a job that needs both joins once."""
    windows = context.withColumn("_open", F.col("sched_start") - seconds(hours * 3600))
    prints = trades.select("ticker", "created_time", "taker_outcome_side", "yes_price_dollars")
    return interval_join(
        prints, windows, ["ticker"], "created_time", "_open", "sched_start", bin_hours * 3600
    ).withColumn("p_cents", cents("yes_price_dollars"))


def window_trades(prints: DataFrame) -> DataFrame:
    return prints.select(
        "game_pk",
        "ticker",
        "side",
        F.col("yes_price_dollars").cast("double").alias("p"),
        "y",
        "taker_outcome_side",
        "created_time",
        "sched_start",
    )


def _last_prints(trades: DataFrame, unit: list[str]) -> DataFrame:
    """Per unit: the latest time, the cent sum and number of prints at it.

    Prints are first summed per (unit, time): that shuffle is spread by time, so
    a hot market is no bottleneck. The choice of the latest then combines
    map-side to one row per unit and task."""
    at_time = trades.groupBy(*unit, "created_time").agg(
        F.sum("p_cents").alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    last = F.max_by(F.struct("created_time", "_sum", "_n"), "created_time")
    return at_time.groupBy(*unit).agg(last.alias("_last")).select(*unit, "_last.*")


def _latest_across_markets(prints: DataFrame, unit: list[str], attributes: dict[str, str]) -> DataFrame:
    """Merge the few markets of one (game, side): only those whose last print is
    the unit's latest count; prices of tied prints average exactly (integer
    cents, one division)."""
    by_time = prints.groupBy(*unit, "created_time").agg(
        (F.sum("_sum") / (F.lit(100.0) * F.sum("_n"))).alias("p"),
        *[F.min(src).alias(dst) for dst, src in attributes.items()],
    )
    row = F.struct("created_time", "p", *attributes)
    return (
        by_time.groupBy(*unit)
        .agg(F.max_by(row, "created_time").alias("_row"))
        .select(*unit, "_row.*")
    )


def pre_snapshots(
    trades: DataFrame,
    context: DataFrame,
    weather: DataFrame,
    win_probability: DataFrame,
    hours: float = 24,
    bin_hours: float = 4,
) -> DataFrame:
    """One row per (game, side): the last price before the start, with weather
    and the opening win probability of that side."""
    windows = context.select(
        "ticker", "sched_start", (F.col("sched_start") - seconds(hours * 3600)).alias("_open")
    )
    ticks = trades.select("ticker", "created_time", cents("yes_price_dollars").alias("p_cents"))
    in_window = interval_join(
        ticks, windows, ["ticker"], "created_time", "_open", "sched_start", bin_hours * 3600
    )
    return snapshots_at_start(in_window, context, weather, win_probability)


def snapshots_at_start(
    in_window: DataFrame, context: DataFrame, weather: DataFrame, win_probability: DataFrame
) -> DataFrame:
    """``pre_snapshots`` of prints in their windows: ticker, created_time, p_cents."""
    prints = _last_prints(in_window, ["ticker"]).join(context, "ticker")
    snap = _latest_across_markets(
        prints,
        ["game_pk", "side"],
        {
            "event_ticker": "event_ticker",
            "ticker": "ticker",
            "team": "team",
            "y": "y",
            "sched_start": "sched_start",
        },
    )
    wx = weather.select(
        "game_pk", "condition", F.col("temp").try_cast("int").alias("temp_f"), wind_mph("wind").alias("wind_mph")
    )
    return (
        snap.join(wx, "game_pk", "left")
        .join(opening_probability(win_probability), "game_pk", "left")
        .select(
            "game_pk",
            "event_ticker",
            "ticker",
            "team",
            "side",
            F.year("sched_start").alias("season"),
            "p",
            "y",
            "created_time",
            "sched_start",
            "condition",
            "temp_f",
            "wind_mph",
            _side_probability().alias("mlb_wp"),
        )
    )


def _side_probability() -> Column:
    return F.when(F.col("side") == "home", F.col("_home_wp")).otherwise(F.col("_away_wp"))


def opening_probability(win_probability: DataFrame) -> DataFrame:
    """Win probability of the first at-bat per game."""
    first = F.min_by(F.struct("home_wp", "away_wp"), "at_bat_index")
    return (
        win_probability.groupBy("game_pk")
        .agg(first.alias("_wp"))
        .select(
            "game_pk",
            (F.col("_wp.home_wp") / 100.0).alias("_home_wp"),
            (F.col("_wp.away_wp") / 100.0).alias("_away_wp"),
        )
    )


def entering_probability(win_probability: DataFrame, plays: DataFrame) -> DataFrame:
    """Win probability after the last at-bat of an inning, as that of entering
    the next one."""
    last = F.max_by(F.struct("home_wp", "away_wp"), "at_bat_index")
    return (
        win_probability.join(
            plays.select("game_pk", "at_bat_index", "inning"), ["game_pk", "at_bat_index"]
        )
        .groupBy("game_pk", (F.col("inning") + 1).alias("entering"))
        .agg(last.alias("_wp"))
        .select(
            "game_pk",
            "entering",
            (F.col("_wp.home_wp") / 100.0).alias("_home_wp"),
            (F.col("_wp.away_wp") / 100.0).alias("_away_wp"),
        )
    )


def interval_snapshots(
    trades: DataFrame,
    context: DataFrame,
    plays: DataFrame,
    win_probability: DataFrame,
    entering: tuple[int, int] = (2, 10),
    bin_hours: float = 4,
) -> DataFrame:
    """One row per (game, side, entering inning): the last price during the
    preceding inning, with the win probability at its end."""
    # a game's few innings meet in one window, in the partitions of the join with its markets
    inning = Window.partitionBy("game_pk").orderBy("inning")
    spans = (
        interval_starts(plays)
        .select(
            "game_pk",
            F.lead("inning").over(inning).alias("entering"),
            F.col("inning_start").alias("_from"),
            F.lead("inning_start").over(inning).alias("_until"),
            (F.col("inning") + 1).alias("_next"),
        )
        .filter((F.col("entering") == F.col("_next")) & F.col("entering").between(*entering))
        .drop("_next")
    )
    # one row per (market, inning): small next to the trades
    windows = context.select("ticker", "game_pk").join(spans, "game_pk").select(
        "ticker", "entering", "_from", "_until"
    )
    ticks = trades.select("ticker", "created_time", cents("yes_price_dollars").alias("p_cents"))
    in_window = interval_join(ticks, windows, ["ticker"], "created_time", "_from", "_until", bin_hours * 3600)
    prints = _last_prints(in_window, ["ticker", "entering"]).join(context, "ticker")
    snap = _latest_across_markets(
        prints, ["game_pk", "side", "entering"], {"ticker": "ticker", "team": "team", "y": "y"}
    )
    return snap.join(
        entering_probability(win_probability, plays), ["game_pk", "entering"], "left"
    ).select(
        "game_pk",
        "ticker",
        "team",
        "side",
        "entering",
        "p",
        "y",
        "created_time",
        _side_probability().alias("mlb_wp"),
    )


def disposition() -> Column:
    """Why a market is in or out of the universe."""
    return (
        F.when(F.col("status") != "finalized", "not finalized")
        .when(F.col("market_type") != "binary", "not binary")
        .when(F.col("result") == "scalar", "scalar result")
        .when(F.coalesce("yes_sub_title", F.lit("")).isin(*EXHIBITION_LABELS), "All-Star")
        .otherwise("kept")
    )


def exclusion_accounting(markets: DataFrame) -> DataFrame:
    return markets.groupBy(disposition().alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


def coverage_report(markets: DataFrame, context: DataFrame, window_trades: DataFrame) -> DataFrame:
    """One row: duplicate listings, label fixes, markets and games without a trade
    in the window."""
    traded = window_trades.select("ticker").distinct().withColumn("_traded", F.lit(1))
    traded_games = window_trades.select("game_pk").distinct()
    listed = context.agg(
        F.countDistinct("event_ticker").alias("n_events"), F.countDistinct("game_pk").alias("n_games")
    )
    fixed = markets.agg(F.count_if(F.col("yes_sub_title").isin(*LABEL_FIXES)).alias("n_label_fixed"))
    quiet = context.join(traded, "ticker", "left").agg(
        F.count_if(F.col("_traded").isNull()).alias("n_markets_no_window")
    )
    quiet_games = (
        context.select("game_pk").distinct().join(traded_games, "game_pk", "left_anti")
        .agg(F.count(F.lit(1)).alias("n_games_no_window"))
    )
    return one_row(listed, fixed, quiet, quiet_games).withColumn(
        "n_duplicate_listings", F.col("n_events") - F.col("n_games")
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side (by union and max, so no cross join)."""
    merged = union(*frames, missing=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def build_info(
    trades: DataFrame, context: DataFrame, pre: DataFrame, innings: DataFrame
) -> DataFrame:
    """The row that makes a frozen build visible (``built_at`` is added on write)."""
    traded = trades.join(context.select("ticker"), "ticker", "left_semi").agg(
        F.min("created_time").cast("date").alias("data_start"),
        F.max("created_time").cast("date").alias("data_end"),
    )
    sizes = context.agg(
        F.countDistinct("game_pk").alias("n_games"), F.count(F.lit(1)).alias("n_markets")
    )
    return one_row(
        traded,
        sizes,
        pre.agg(F.count(F.lit(1)).alias("n_pre_snapshots")),
        innings.agg(F.count(F.lit(1)).alias("n_inning_snapshots")),
    )
