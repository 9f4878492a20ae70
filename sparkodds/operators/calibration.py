"""Calibration and deviation tables. Every cut is one grouped aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkodds.functions.stats import condition_group, price_bucket, temp_band, wind_band, with_deviation
from sparkodds.functions.timefn import col, micros
from sparkodds.operators.quantiles import exact_quantiles
from sparkodds.operators.snapshots import one_row
from sparkodds.operators.unions import union
from sparkodds.session import materialize

MIN_SAMPLES = 30


def _measures() -> list[Column]:
    return [
        F.avg("p").alias("avg_price"),
        F.avg("y").alias("win_rate"),
        F.count(F.lit(1)).alias("n_samples"),
    ]


def calibration(
    df: DataFrame,
    where: Column | str | None = None,
    buckets: int = 10,
    by: Sequence[str] = (),
) -> DataFrame:
    """Price buckets (per slice in ``by``): average price, win rate, samples and
    deviation. All slices come from one aggregate, not one job each."""
    rows = df if where is None else df.filter(where)
    grouped = rows.groupBy(*by, price_bucket("p", buckets).alias("bucket")).agg(*_measures())
    return with_deviation(grouped)


def group_deviation(
    df: DataFrame,
    expr: Column | str,
    where: Column | str | None = None,
    name: str = "grp",
    order_value: Column | str | None = None,
) -> DataFrame:
    """The same measures per group expression; with ``order_value`` also its
    minimum per group, to sort bands by."""
    rows = df if where is None else df.filter(where)
    extra = [] if order_value is None else [F.min(col(order_value)).alias("sort_value")]
    grouped = rows.groupBy(col(expr).alias(name)).agg(*_measures(), *extra)
    return with_deviation(grouped)


def significant(df: DataFrame) -> DataFrame:
    """Buckets whose deviation interval leaves out zero."""
    return df.filter((F.col("dev_lo") > 0) | (F.col("dev_hi") < 0))


def dense(df: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    return df.filter(F.col("n_samples") >= min_samples)


def by_team(df: DataFrame, team: str = "team") -> DataFrame:
    """Deviation per team, largest first."""
    return group_deviation(df, team, name=team).orderBy(F.desc("deviation"), team)


def season_halves(df: DataFrame) -> DataFrame:
    """Add ``half``: early up to the season's median start, late after."""
    starts = df.select("season", micros("sched_start").alias("_at"))
    # one row per season, written so that Spark knows its size and need not shuffle the rows
    medians = materialize(exact_quantiles(starts, ["season"], "_at", {"_median": 0.5}).drop("n"))
    return (
        df.join(medians, "season")
        .withColumn("half", F.when(micros("sched_start") <= F.col("_median"), "early").otherwise("late"))
        .drop("_median")
    )


def period_summary(halves: DataFrame) -> DataFrame:
    return halves.groupBy("season", "half").agg(
        F.min("sched_start").cast("date").alias("first_game"),
        F.max("sched_start").cast("date").alias("last_game"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def by_interval(pre: DataFrame, innings: DataFrame, side: str = "home", buckets: int = 10) -> DataFrame:
    """Calibration before the game, entering innings 2-9, and entering extras."""
    label = F.when(F.col("entering") == 10, "extras").otherwise(
        F.concat(F.lit("inning "), F.col("entering").cast("string"))
    )
    rows = union(
        pre.filter(F.col("side") == side).select(F.lit("pre-game").alias("inning"), "p", "y"),
        innings.filter((F.col("side") == side) & F.col("entering").between(2, 10)).select(
            label.alias("inning"), "p", "y"
        ),
    )
    return calibration(rows, buckets=buckets, by=["inning"])


def weather_rows(pre: DataFrame) -> DataFrame:
    """Pre-game rows with their condition group and bands."""
    return pre.select(
        "game_pk",
        "p",
        "y",
        condition_group().alias("condition_group"),
        "temp_f",
        "wind_mph",
        temp_band().alias("temp_band"),
        wind_band().alias("wind_band"),
    )


def by_condition(wx: DataFrame) -> DataFrame:
    return group_deviation(wx, "condition_group", name="condition")


def by_temperature(wx: DataFrame) -> DataFrame:
    """Outdoor games only; games without a reading are left out."""
    return group_deviation(wx, "temp_band", _outdoor("temp_f"), "temperature", "temp_f")


def by_wind(wx: DataFrame) -> DataFrame:
    return group_deviation(wx, "wind_band", _outdoor("wind_mph"), "wind", "wind_mph")


def calibration_by_band(wx: DataFrame, band: str, reading: str, buckets: int = 10) -> DataFrame:
    """Outdoor calibration curves, one per temperature or wind band."""
    return calibration(wx, _outdoor(reading), buckets, by=[band])


def _outdoor(reading: str) -> Column:
    return (F.col("condition_group") != "roof/dome") & F.col(reading).isNotNull()


def complement_totals(pre: DataFrame) -> DataFrame:
    """Sum of both sides' prices, for games that have both."""
    return (
        pre.groupBy("game_pk")
        .agg(F.sum("p").alias("total"), F.count(F.lit(1)).alias("_n"))
        .filter("_n = 2")
        .select("game_pk", "total")
    )


def complement_check(pre: DataFrame) -> DataFrame:
    """One row: how close the two sides' prices come to one dollar."""
    totals = complement_totals(pre)
    off = F.abs(F.col("total") - 1)
    counts = totals.agg(
        F.count(F.lit(1)).alias("n_games"),
        F.count_if(off <= 0.01).alias("within_1c"),
        F.count_if(off <= 0.02).alias("within_2c"),
        F.count_if(off > 0.05).alias("beyond_5c"),
        F.min("total").alias("min_total"),
        F.max("total").alias("max_total"),
    )
    median = exact_quantiles(totals, [], "total", {"med_total": 0.5}).drop("n")
    return one_row(counts, median)
