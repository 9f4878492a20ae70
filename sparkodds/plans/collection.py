"""The matched-pairs job: both venues' listings of a day → stored pairs → what to
subscribe to."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds import schemas
from sparkodds.operators import matching, planning
from sparkodds.operators.unions import union
from sparkodds.session import materialize
from sparkodds.sources import sinks

PAIRS, KEY, DAY = "matched_markets", "kalshi_event_ticker", "game_date"


@dataclass
class Collection:
    """What one run of the job found: this run's pairs, the day's subscriptions
    (earlier runs' too) and the listings left over on either side."""

    matched: DataFrame
    subscriptions: DataFrame
    unmatched: DataFrame


def stored_pairs(spark: SparkSession, path: str, days: list[date] | None = None) -> DataFrame:
    """The pairs stored below ``path``, of some days only if given; none before the
    first run."""
    empty = spark.createDataFrame([], schemas.table_schema(PAIRS))
    if not sinks.exists(spark, f"{path}/{PAIRS}"):
        return empty
    pairs = schemas.conform(sinks.stored_table(spark, f"{path}/{PAIRS}", empty, [DAY]), PAIRS)
    return pairs if days is None else pairs.filter(F.col(DAY).isin(days))


def store_pairs(matched: DataFrame, path: str) -> None:
    """Store a run's pairs, one folder a day. The stored pair of an event that is
    matched again is replaced and hands its id on; pairs of events that this run
    doesn't have stay, so a restart loses no game whose listings are gone. New
    ids follow the order of day, teams and slug, above all earlier ones.

    An event ticker names its day, so only the days of this run are read and
    rewritten; of several pairs of one event, as ``match_venues`` never gives, the
    smallest slug counts. No pairs, no write."""
    spark = matched.sparkSession
    pairs = materialize(
        matching.keep_first(matched.drop("id"), [KEY], ["poly_slug", *(c for c in matched.columns if c not in ("id", KEY, "poly_slug"))])
    )
    days = [r[0] for r in pairs.select(DAY).distinct().collect()]  # a run has one, a backfill a few hundred
    if not days:
        return
    known = materialize(stored_pairs(spark, path, days).groupBy(KEY).agg(F.min("id").alias("id")))
    again = pairs.join(known, KEY)
    new, _ = sinks.numbered(pairs.join(known, KEY, "left_anti").orderBy(DAY, "away_team", "home_team", "poly_slug", KEY))
    sinks.replace_keys(schemas.conform(union(again, new), PAIRS), f"{path}/{PAIRS}", KEY, [DAY])


def run(a: DataFrame, b: DataFrame, path: str, day: date) -> Collection:
    """Match the two venues' listings of ``day`` (see ``matching.match_venues``), store
    the pairs below ``path`` and give the day's subscriptions. Listings of other
    days are left alone."""
    today = F.col(DAY) == F.lit(day)
    a, b = materialize(a.filter(today)), materialize(b.filter(today))
    matched = materialize(matching.match_venues(a, b))
    store_pairs(matched, path)
    pairs = stored_pairs(a.sparkSession, path, [day])
    return Collection(matched, planning.subscriptions(pairs, day.isoformat()), matching.unmatched_venues(a, b, matched))


def slugs_paired_twice(pairs: DataFrame) -> DataFrame:
    """(game_date, poly_slug, n_events) of slugs that several stored events of a day
    have: an earlier run's pair stays when its slug is matched to another event
    later, and each of its books would then count for both games."""
    counted = pairs.groupBy(DAY, "poly_slug").agg(F.countDistinct(KEY).alias("n_events"))
    return counted.filter("n_events > 1")
