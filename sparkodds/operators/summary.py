"""Opportunity value, thresholds, freshness, spread and lag summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkodds.functions import fmt
from sparkodds.functions.timefn import boundaries_between, col, elapsed_seconds
from sparkodds.operators.quantiles import exact_quantiles
from sparkodds.operators.snapshots import one_row

# Liquidity thresholds and their labels.
COUNT_THRESHOLDS = [1, 10, 50, 100, 500, 1000, 5000]
SIZE_THRESHOLDS = {"all": 0, "≥1": 1, "≥10": 10, "≥100": 100, "≥1,000": 1000}
BOX_THRESHOLDS = {"≥1": 1, "≥10": 10, "≥100": 100, "≥1k": 1000}
PERSISTENT_SECONDS = 1.0


def profitable(eps: DataFrame) -> DataFrame:
    return eps.filter(F.col("max_net_arb") > 0)


def with_value(eps: DataFrame) -> DataFrame:
    """Dollar value: bottleneck size times the peak net edge."""
    return eps.withColumn("max_dollar_value", F.col("bottleneck_liquidity") * F.col("max_net_arb"))


def _per_game(total: Column | str) -> Column:
    """``total`` per game; NaN, as 0 / 0, where there are no games."""
    n = F.col("n_games")
    return F.when(n != 0, col(total) / n).otherwise(F.lit(float("nan")))


def rates(eps: DataFrame) -> DataFrame:
    """One row: gross and net opportunities, per game too."""
    return eps.agg(
        F.count(F.lit(1)).alias("n_gross"),
        F.count_if(F.col("max_net_arb") > 0).alias("n_net"),
        F.countDistinct("game_key").alias("n_games"),
    ).withColumns(
        {
            "gross_per_game": _per_game("n_gross"),
            "net_per_game": _per_game("n_net"),
        }
    )


def total_value(eps: DataFrame) -> DataFrame:
    """Value of the net-profitable episodes, in total and per game of all episodes."""
    net_value = F.when(F.col("max_net_arb") > 0, F.col("bottleneck_liquidity") * F.col("max_net_arb"))
    return eps.agg(
        F.coalesce(F.sum(net_value), F.lit(0.0)).alias("total_value"),
        F.countDistinct("game_key").alias("n_games"),
    ).withColumn("value_per_game", _per_game("total_value"))


def top_value(eps: DataFrame, k: int = 15) -> DataFrame:
    """The k most valuable net opportunities (a top-k plan, not a full sort)."""
    return (
        with_value(profitable(eps))
        .orderBy(F.desc("max_dollar_value"), "start_ts", "game_key")
        .limit(k)
        .select("game_key", "game_date", "direction", "max_net_arb", "bottleneck_liquidity", "max_dollar_value")
    )


def top_value_table(top: DataFrame) -> DataFrame:
    return top.select(
        F.col("game_key").alias("game"),
        F.col("game_date").alias("date"),
        "direction",
        fmt.cents("max_net_arb", 2).alias("peak arb/contract"),
        F.round("bottleneck_liquidity", 0).cast("bigint").alias("bottleneck"),
        fmt.dollars("max_dollar_value").alias("value"),
    )


def liquidity_counts(eps: DataFrame, thresholds: Sequence[int] = COUNT_THRESHOLDS) -> DataFrame:
    """Overlapping counts in one pass."""
    size = F.col("bottleneck_liquidity")
    return eps.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(size >= t).alias(f"gte_{t}") for t in thresholds],
    )


def _per_threshold(eps: DataFrame, thresholds: dict[str, float], value: Column, positive: bool) -> DataFrame:
    """(liquidity, value, n): values counted per the highest threshold they reach
    first, and only then listed under every threshold they pass."""
    size = F.col("bottleneck_liquidity")
    ordered = sorted(thresholds.items(), key=lambda kv: kv[1])
    reached = F.lit(0)
    for _, limit in ordered:
        passes = size >= limit if (limit > 0 or positive) else F.lit(True)
        reached = reached + F.when(passes, 1).otherwise(0)
    labels = F.array(*[F.lit(label) for label, _ in ordered])
    counted = eps.groupBy(reached.alias("_reached"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.filter("_reached > 0")
        .select(F.explode(F.slice(labels, F.lit(1), F.col("_reached"))).alias("liquidity"), "value", "n")
    )


def by_threshold(
    eps: DataFrame,
    value: Column | str,
    scale: float = 1.0,
    thresholds: dict[str, float] = SIZE_THRESHOLDS,
) -> DataFrame:
    """Per threshold: episode count, median and mean of ``value``; zeros where no
    episode reaches the threshold."""
    spark = eps.sparkSession
    listed = _per_threshold(eps, thresholds, col(value), positive=False)
    mean = listed.groupBy("liquidity").agg(
        F.sum("n").alias("count"), (F.sum(F.col("value") * F.col("n")) / F.sum("n") * scale).alias("mean")
    )
    median = exact_quantiles(listed, ["liquidity"], "value", {"median": 0.5}, weight="n").drop("n")
    labels = spark.createDataFrame([(k, float(v)) for k, v in thresholds.items()], "liquidity string, at_least double")
    return (
        labels.join(mean, "liquidity", "left")
        .join(median, "liquidity", "left")
        .select(
            "liquidity",
            "at_least",
            F.coalesce("count", F.lit(0)).alias("count"),
            F.coalesce(F.col("median") * scale, F.lit(0.0)).alias("median"),
            F.coalesce("mean", F.lit(0.0)).alias("mean"),
        )
    )


def size_by_threshold(eps: DataFrame) -> DataFrame:
    """Peak net edge in cents per liquidity threshold."""
    return by_threshold(eps, "max_net_arb", 100.0)


def duration_by_threshold(eps: DataFrame) -> DataFrame:
    return by_threshold(eps, "duration_s")


def box_summary(
    eps: DataFrame, value: Column | str, scale: float = 1.0, thresholds: dict[str, float] = BOX_THRESHOLDS
) -> DataFrame:
    """Five numbers and n per threshold that any episode reaches."""
    listed = _per_threshold(eps, thresholds, col(value) * scale, positive=True)
    five = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return exact_quantiles(listed, ["liquidity"], "value", five, weight="n")


def direction_split(eps: DataFrame) -> DataFrame:
    return (
        with_value(eps)
        .groupBy("direction")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("max_dollar_value").alias("value"))
    )


def persistent_summary(eps: DataFrame, min_seconds: float = PERSISTENT_SECONDS) -> DataFrame:
    """Net opportunities that last: count, value, value per game of all episodes."""
    lasting = (F.col("max_net_arb") > 0) & (F.col("duration_s") >= min_seconds)
    value = F.col("bottleneck_liquidity") * F.col("max_net_arb")
    return eps.agg(
        F.count_if(lasting).alias("n_persistent"),
        F.coalesce(F.sum(F.when(lasting, value)), F.lit(0.0)).alias("value_persistent"),
        F.countDistinct("game_key").alias("n_games"),
    ).withColumn("value_per_game", _per_game("value_persistent"))


def freshness(pre: DataFrame, side: str = "home", n_games: DataFrame | None = None) -> DataFrame:
    """Snapshot age at the start, in minutes."""
    ages = pre.filter(F.col("side") == side).select(
        boundaries_between("minute", "created_time", "sched_start").alias("_mins")
    )
    probs = {"median_mins": 0.5, "p90_mins": 0.9, "p99_mins": 0.99}
    # a snapshot has both times, so every one has an age
    out = exact_quantiles(ages, [], "_mins", probs).select(F.coalesce("n", F.lit(0)).alias("n_snapshots"), *probs)
    if n_games is None:
        return out
    return one_row(out, n_games.select("n_games")).withColumn(
        "n_missing", F.col("n_games") - F.col("n_snapshots")
    ).drop("n_games")


def spread_legs(window_trades: DataFrame, side: str = "home", tie: Sequence[str] = ()) -> DataFrame:
    """Per game the last price a YES taker paid and the last a NO taker hit."""

    def last_price(outcome: str) -> Column:
        hit = F.col("taker_outcome_side") == outcome
        return F.max_by(F.when(hit, F.col("p")), F.when(hit, F.struct("created_time", *tie)))

    return (
        window_trades.filter(F.col("side") == side)
        .groupBy("game_pk")
        .agg(last_price("yes").alias("ask_proxy"), last_price("no").alias("bid_proxy"))
    )


def spread_summary(legs: DataFrame, wide: float = 0.03) -> DataFrame:
    gaps = legs.select((F.col("ask_proxy") - F.col("bid_proxy")).alias("gap"))
    counts = gaps.agg(
        F.count(F.lit(1)).alias("n_games"),
        F.count("gap").alias("n_both_sides"),
        F.count_if(F.col("gap") > wide).alias("n_wide"),
        F.count_if(F.col("gap") < 0).alias("n_crossed"),
    )
    quantiles = exact_quantiles(gaps, [], "gap", {"med_gap": 0.5, "p90_gap": 0.9}).drop("n")
    return one_row(counts, quantiles)


def feed_lag(snapshots: DataFrame, recv: str, source: str, by: Sequence[str] = ("platform",)) -> DataFrame:
    """Receive minus source time per platform, in milliseconds, and the rows
    without a source time."""
    lag = (elapsed_seconds(source, recv) * 1000).alias("_lag")
    rows = snapshots.select(*by, F.col(source).alias("_src"), lag)
    missing = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_src").isNull()).alias("n_missing")
    )
    quantiles = exact_quantiles(rows, list(by), "_lag", {"p50_ms": 0.5, "p99_ms": 0.99}).drop("n")
    return missing.join(quantiles, list(by), "left")
