"""The calibration job: typed tables → market context → snapshots, with its
accounting and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkodds.operators import quality, snapshots
from sparkodds.operators.unions import union
from sparkodds.session import materialize
from sparkodds.sources import sinks


@dataclass
class Calibration:
    context: DataFrame
    window_trades: DataFrame
    pre: DataFrame
    innings: DataFrame


def build(
    markets: DataFrame,
    trades: DataFrame,
    event_map: DataFrame,
    games: DataFrame,
    plays: DataFrame,
    win_probability: DataFrame,
    weather: DataFrame,
    hours: float = 24,
    bin_hours: float = 4,
) -> Calibration:
    """The prepared frames, lazy but for the market dimension all of them read and
    the trades before the starts, which are joined once for two of them."""
    context = materialize(snapshots.market_context(snapshots.universe(markets), event_map, games))
    prints = materialize(snapshots.window_prints(trades, context, hours, bin_hours))
    return Calibration(
        context,
        snapshots.window_trades(prints),
        snapshots.snapshots_at_start(prints, context, weather, win_probability),
        snapshots.interval_snapshots(trades, context, plays, win_probability, bin_hours=bin_hours),
    )


def checks(universe: DataFrame, c: Calibration, n_teams: int | None = quality.N_TEAMS) -> DataFrame:
    """(check, n_bad) over the prepared tables."""
    by_row = [
        quality.prepared_checks(c.pre, "pre"),
        quality.prepared_checks(c.innings, "inning"),
        quality.prepared_checks(c.window_trades, "window"),
        quality.violations(c.pre, quality.bad_start()),
    ]
    return union(*by_row, checks_across(universe, c, n_teams))


def checks_across(universe: DataFrame, c: Calibration, n_teams: int | None = quality.N_TEAMS) -> DataFrame:
    """The checks that compare rows."""
    unmapped = universe.join(c.context.select("ticker"), "ticker", "left_anti").agg(
        F.count(F.lit(1)).alias("n_bad")
    )
    parts = [
        unmapped.select(F.lit("unmapped_markets").alias("check"), "n_bad"),
        quality.duplicates(c.pre, ["game_pk", "side"], "pre_grain"),
        quality.duplicates(c.innings, ["game_pk", "side", "entering"], "inning_grain"),
        quality.one_sided(c.pre, "game_pk", "side").select(F.lit("one_sided").alias("check"), "n_bad"),
    ]
    if n_teams is not None:
        labels = c.pre.agg(F.countDistinct("team").alias("_n"))
        parts.append(
            labels.select(F.lit("n_teams").alias("check"), F.abs(F.col("_n") - n_teams).alias("n_bad"))
        )
    return union(*parts)


def write(c: Calibration, trades: DataFrame, universe: DataFrame, path: str, n_teams: int | None = quality.N_TEAMS) -> Calibration:
    """Rebuild the prepared tables below ``path``. They are written aside and gated
    first, so tables that fail a check replace nothing. What a row fails by itself
    is counted while it is written."""

    def staging(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
        stored, found = quality.written(df, bad)
        quality.gate_counts(found, bad)
        return stored

    staged = Calibration(
        c.context,
        staging(c.window_trades, quality.bad_prepared("window")),
        staging(c.pre, {**quality.bad_prepared("pre"), **quality.bad_start()}),
        staging(c.innings, quality.bad_prepared("inning")),
    )
    quality.gate(checks_across(universe, staged, n_teams))
    info = snapshots.build_info(trades, c.context, staged.pre, staged.innings)
    stored = Calibration(
        c.context,
        sinks.rebuild(staged.window_trades, f"{path}/mlb_calib_pre_window_trades"),
        sinks.rebuild(staged.pre, f"{path}/mlb_calib_pre_snapshots"),
        sinks.rebuild(staged.innings, f"{path}/mlb_calib_inning_snapshots"),
    )
    sinks.rebuild(sinks.with_built_at(info), f"{path}/mlb_calib_build_info")
    return stored
