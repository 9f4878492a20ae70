"""Data-quality checks. A check is a one-row aggregate; many checks of one table
share a single pass, and checks that a row fails by itself are counted in the pass
that writes the table (``written``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkodds.functions.timefn import boundaries_between, from_micros, seconds
from sparkodds.operators.unions import union
from sparkodds.session import materialize

# Known market statuses, team count, thresholds.
KNOWN_STATUSES = [
    "initialized", "inactive", "active", "closed", "determined", "disputed", "amended", "finalized",
]
N_TEAMS = 30
MIN_MATCH_RATE = 0.99


class QualityError(AssertionError):
    """A gate found violations."""


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n_bad): rows for which each condition holds, in one pass."""
    names = list(checks)
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_bad")) for n in names]))
    )


N_ROWS = "n_rows"


def written(df: DataFrame, checks: dict[str, Column] | None = None, **metrics: Column) -> tuple[DataFrame, dict[str, object]]:
    """Write an intermediate table and count in the same pass: its rows, for each
    check the rows for which the condition holds, and further aggregates without
    DISTINCT. They are observed in the stage that writes; of its tasks Spark
    counts each once, also when it runs again after a lost executor."""
    aggregates = {N_ROWS: F.count(F.lit(1)), **{n: F.count_if(c) for n, c in (checks or {}).items()}, **metrics}
    named = [c.alias(n) for n, c in aggregates.items()]
    seen = Observation()
    stored = materialize(df.observe(seen, *named))
    # a plan that Spark finds to be empty may not get as far as the counting
    found = seen.get or stored.agg(*named).first().asDict()
    return stored, {n: found[n] for n in aggregates}


def written_rows(df: DataFrame, what: str, least: int = 1) -> DataFrame:
    """Write a required source; abort if it holds too few rows, without a second
    look at it."""
    stored, found = written(df)
    if found[N_ROWS] < least:
        raise QualityError(f"{found[N_ROWS]} rows in {what}, not {least}" if found[N_ROWS] else f"no rows in {what}")
    return stored


def gate_counts(found: dict[str, object], checks: dict[str, Column]) -> None:
    """Raise when rows written by ``written`` fail any of its checks."""
    bad = {n: found[n] for n in checks if found[n]}
    if bad:
        raise QualityError(", ".join(f"{n}: {v}" for n, v in bad.items()))


def castability(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Non-NULL values that do not cast, per column, in one pass."""
    return violations(
        df, {c: F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() for c, t in types.items()}
    )


def orphans(
    children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, name: str
) -> DataFrame:
    """Child rows without a parent. Counting per key first keeps a hot key from
    travelling row by row."""
    keys = children.groupBy(child_key).agg(F.count(F.lit(1)).alias("_n"))
    lost = keys.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_bad")).select(
        F.lit(name).alias("check"), "n_bad"
    )


def duplicates(df: DataFrame, grain: Sequence[str], name: str) -> DataFrame:
    """Keys that occur more than once at what should be the grain."""
    return (
        df.groupBy(*grain)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .agg(F.count(F.lit(1)).alias("n_bad"))
        .select(F.lit(name).alias("check"), "n_bad")
    )


def unknown_values(df: DataFrame, c: str, known: Sequence[str], name: str) -> DataFrame:
    """Distinct values outside the domain."""
    return (
        df.select(c).distinct().filter(F.col(c).isNotNull() & ~F.col(c).isin(*known))
        .agg(F.count(F.lit(1)).alias("n_bad"))
        .select(F.lit(name).alias("check"), "n_bad")
    )


def distinct_across(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values over several columns together."""
    return (
        df.select(F.explode(F.array(*columns)).alias("_v"))
        .agg(F.countDistinct("_v").alias("n_distinct"))
    )


def one_sided(df: DataFrame, group: str, side: str, sides: int = 2) -> DataFrame:
    """Groups that do not show exactly ``sides`` different sides."""
    return (
        df.groupBy(group)
        .agg(F.countDistinct(side).alias("_n"))
        .filter(F.col("_n") != sides)
        .agg(F.count(F.lit(1)).alias("n_bad"))
    )


def tables_missing(spark: SparkSession, names: Sequence[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]


def below_minimum(sizes: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(check, n_rows, minimum) for tables that hold too few rows."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("check"), "n_rows", F.lit(minimum).alias("minimum")
        )
        for name, (df, minimum) in sizes.items()
    ]
    return union(*parts).filter("n_rows <= minimum")


def gate(checks: DataFrame) -> DataFrame:
    """Raise when any check has violations; the checks are few rows."""
    bad = checks.filter("n_bad > 0").collect()
    if bad:
        raise QualityError(", ".join(f"{r['check']}: {r['n_bad']}" for r in bad))
    return checks


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Abort on an empty required source."""
    if df.isEmpty():
        raise QualityError(f"no rows in {what}")
    return df


# Checks of the domain tables


def trade_checks(trades: DataFrame) -> DataFrame:
    yes, no = F.col("yes_price_dollars"), F.col("no_price_dollars")
    return violations(
        trades,
        {
            "price_range": (yes <= 0) | (yes >= 1) | (no <= 0) | (no >= 1),
            "price_complement": F.abs(yes + no - 1) > 0.000001,
            "count_positive": F.col("count_fp") <= 0,
            "from_future": F.col("created_time") >= from_micros(F.unix_micros(F.current_timestamp())) + seconds(86400),
        },
    )


def market_checks(markets: DataFrame) -> DataFrame:
    return violations(
        markets,
        {
            "close_after_open": F.col("close_time") <= F.col("open_time"),
            "finalized_has_result": (F.col("status") == "finalized")
            & (F.coalesce("result", F.lit("")) == ""),
        },
    )


def trade_time_checks(trades: DataFrame, markets: DataFrame, grace_seconds: float = 300) -> DataFrame:
    """Trades before their market opened, or later than its close plus a grace."""
    hours = markets.select("ticker", "open_time", "close_time")
    return violations(
        trades.select("ticker", "created_time").join(hours, "ticker"),
        {
            "before_open": F.col("created_time") < F.col("open_time"),
            "after_close": F.col("created_time") > F.col("close_time") + seconds(grace_seconds),
        },
    )


def game_checks(games: DataFrame) -> DataFrame:
    final = F.col("coded_game_state") == "F"
    incomplete = (
        F.col("away_score").isNull()
        | F.col("home_score").isNull()
        | F.col("away_is_winner").isNull()
        | F.col("home_is_winner").isNull()
    )
    return violations(
        games,
        {
            "final_complete": final & incomplete,
            "one_winner": final & (F.col("away_is_winner") == F.col("home_is_winner")),
        },
    )


def play_time_checks(plays: DataFrame, games: DataFrame, hours: int = 48) -> DataFrame:
    """Plays far from the scheduled start, counted in hour boundaries."""
    rows = plays.select("game_pk", "start_time").join(games.select("game_pk", "game_date"), "game_pk")
    return violations(
        rows,
        {
            "play_near_start": F.col("start_time").isNotNull()
            & (F.abs(boundaries_between("hour", "game_date", "start_time")) > hours)
        },
    )


def win_probability_checks(wp: DataFrame) -> DataFrame:
    home, away = F.col("home_wp"), F.col("away_wp")
    return violations(
        wp,
        {
            "wp_range": (home < 0) | (home > 100) | (away < 0) | (away > 100),
            "wp_complement": F.abs(home + away - 100) > 0.01,
        },
    )


def bad_prepared(name: str) -> dict[str, Column]:
    """Prices outside (0, 1), outcomes but 0 and 1."""
    p, y = F.col("p"), F.col("y")
    return {f"{name}_p_y": (p <= 0) | (p >= 1) | ~y.isin(0, 1)}


def bad_start() -> dict[str, Column]:
    return {"null_start": F.col("sched_start").isNull()}


def bad_states() -> dict[str, Column]:
    return {
        "gross_negative": F.col("gross_arb") < -1e-10,
        "k_spread_negative": F.col("k_spread") < -0.0002,
        "p_spread_negative": F.col("p_spread") < -0.0002,
    }


def bad_episodes() -> dict[str, Column]:
    return {"duration_negative": F.col("duration_s") < -1e-10}


def prepared_checks(df: DataFrame, name: str) -> DataFrame:
    return violations(df, bad_prepared(name))


def state_checks(states: DataFrame) -> DataFrame:
    return violations(states, bad_states())


def episode_checks(eps: DataFrame) -> DataFrame:
    return violations(eps, bad_episodes())
