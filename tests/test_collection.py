"""The matched-pairs job: stores of several runs, ids, subscriptions."""

from datetime import date, datetime

from pyspark.sql import functions as F

from sparkodds.plans import collection
from sparkodds.sources import sinks

DAY, NEXT = date(2026, 7, 30), date(2026, 7, 31)
A = "event_ticker string, game_date date, away string, home string, away_ticker string, home_ticker string, start_utc timestamp_ntz"
B = "slug string, event_slug string, game_date date, away string, home string, start_utc timestamp_ntz"


def venue_a(spark, *events):
    return spark.createDataFrame([(e, day, away, home, f"{e}-{away}", f"{e}-{home}", datetime(2026, 7, 30, 17)) for e, day, away, home in events], A)


def venue_b(spark, *asks):
    return spark.createDataFrame([(s, f"ev-{s}", day, away, home, datetime(2026, 7, 30, 17)) for s, day, away, home in asks], B)


def pairs(spark, path):
    return {r.kalshi_event_ticker: (r.poly_slug, r.id) for r in collection.stored_pairs(spark, path).collect()}


def test_two_runs_on_one_day_give_the_union(spark, tmp_path):
    path = str(tmp_path)
    a = venue_a(spark, ("E1", DAY, "STL", "PIT"), ("E2", DAY, "NYY", "BOS"), ("N1", NEXT, "STL", "PIT"))
    b = venue_b(spark, ("s1", DAY, "PIT", "STL"), ("s2", DAY, "NYY", "BOS"), ("sn", NEXT, "STL", "PIT"))
    assert collection.stored_pairs(spark, path).count() == 0
    first = collection.run(a, b, path, DAY)
    assert first.matched.count() == 2 and first.unmatched.count() == 0
    before = pairs(spark, path)
    assert set(before) == {"E1", "E2"}
    # E1 has closed, E2 is listed under another slug, E3 is new
    a2 = venue_a(spark, ("E2", DAY, "NYY", "BOS"), ("E3", DAY, "CHC", "MIL"), ("E4", DAY, "SEA", "TEX"))
    second = collection.run(a2, venue_b(spark, ("s2b", DAY, "BOS", "NYY"), ("s3", DAY, "MIL", "CHC")), path, DAY)
    after = pairs(spark, path)
    assert {e: s for e, (s, _) in after.items()} == {"E1": "s1", "E2": "s2b", "E3": "s3"}
    assert after["E1"] == before["E1"] and after["E2"][1] == before["E2"][1]
    assert after["E3"][1] > max(i for _, i in before.values())
    subscribed = [(r.platform, r.market_id) for r in second.subscriptions.collect()]
    assert len(subscribed) == len(set(subscribed)) == 9
    assert {m for p, m in subscribed if p == "polymarket"} == {"s1", "s2b", "s3"}
    assert [r.listing for r in second.unmatched.collect()] == ["E4"]


def test_days_are_stored_apart(spark, tmp_path):
    path = str(tmp_path)
    a = venue_a(spark, ("E1", DAY, "STL", "PIT"), ("N1", NEXT, "STL", "PIT"))
    b = venue_b(spark, ("s1", DAY, "PIT", "STL"), ("sn", NEXT, "STL", "PIT"))
    collection.run(a, b, path, DAY)
    files = set(sinks.table(spark, f"{path}/matched_markets").inputFiles())
    got = collection.run(a, b, path, NEXT)
    assert files < set(sinks.table(spark, f"{path}/matched_markets").inputFiles())  # the first day's weren't written again
    assert {r.market_id for r in got.subscriptions.collect()} == {"N1-STL", "N1-PIT", "sn"}
    assert set(pairs(spark, path)) == {"E1", "N1"}


def test_a_run_without_pairs_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    a, b = venue_a(spark, ("E1", DAY, "STL", "PIT")), venue_b(spark, ("s1", DAY, "PIT", "STL"))
    none = collection.run(a, b.limit(0), path, DAY)
    assert none.subscriptions.count() == 0 and not sinks.exists(spark, f"{path}/matched_markets")
    collection.run(a, b, path, DAY)
    before = pairs(spark, path)
    again = collection.run(a.limit(0), b.limit(0), path, DAY)
    assert pairs(spark, path) == before and again.subscriptions.count() == 3


def test_a_slug_matched_to_another_event_later_is_reported(spark, tmp_path):
    path = str(tmp_path)
    b = venue_b(spark, ("s1", DAY, "PIT", "STL"))
    collection.run(venue_a(spark, ("E1", DAY, "STL", "PIT")), b, path, DAY)
    collection.run(venue_a(spark, ("E9", DAY, "STL", "PIT")), b, path, DAY)
    twice = collection.slugs_paired_twice(collection.stored_pairs(spark, path))
    assert [tuple(r) for r in twice.collect()] == [(DAY, "s1", 2)]


def test_of_pairs_of_one_event_one_is_stored(spark, tmp_path):
    path = str(tmp_path)
    a, b = venue_a(spark, ("E1", DAY, "STL", "PIT")), venue_b(spark, ("s2", DAY, "PIT", "STL"))
    matched = collection.run(a, b, str(tmp_path / "once"), DAY).matched
    collection.store_pairs(matched.union(matched.withColumn("poly_slug", F.lit("s1"))), path)
    assert {e: s for e, (s, _) in pairs(spark, path).items()} == {"E1": "s1"}
