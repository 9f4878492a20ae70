"""Sliced scans, as-of joins, interval joins and quantiles against plain Python,
with one key that holds a third of all rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkodds.operators import asof, intervals, latest, quantiles, slices, snapshots
from sparkodds.plans import fixtures as fx

T0 = datetime(2026, 7, 30)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(20)}"
        at = T0 + timedelta(seconds=rng.randrange(4000) / 4)
        value = None if rng.random() < 0.2 else float(rng.randrange(100))
        out.append((key, at, i, value))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, v double").cache()


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("width", [0.5, 30.0, 1e6])
def test_previous_row_and_numbers(frame, rows, width):
    prev = slices.previous_row(frame, ["k"], "ts", ["ts", "id"], ["v", "id"], "p", width)
    got = {r["id"]: r["p"] for r in prev.collect()}
    numbers = {r["id"]: r["n"] for r in slices.row_numbers(frame, ["k"], "ts", ["ts", "id"], "n", width).collect()}
    sums = {r["id"]: r["s"] for r in slices.running_sum(frame, ["k"], "ts", ["ts", "id"], F.coalesce("v", F.lit(0.0)), "s", width).collect()}
    for group in by_key(rows).values():
        total = 0.0
        for i, r in enumerate(group):
            want = None if i == 0 else (group[i - 1][3], group[i - 1][2])
            assert (tuple(got[r[2]]) if got[r[2]] is not None else None) == want
            total += r[3] or 0.0
            assert numbers[r[2]] == i + 1 and sums[r[2]] == total


def test_overall_numbers(frame, rows):
    got = {r["id"]: r["n"] for r in slices.row_numbers(frame, [], "ts", ["ts", "id"], "n", 60.0).collect()}
    assert got == {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


@pytest.mark.parametrize("width", [1.0, 1e6])
def test_carry_forward(frame, rows, width):
    got = {r["id"]: r["c"] for r in slices.carry_forward(frame, ["k"], "ts", ["ts", "id"], {"c": F.col("v")}, width).collect()}
    for group in by_key(rows).values():
        last = None
        for r in group:
            last = r[3] if r[3] is not None else last
            assert got[r[2]] == last


@pytest.mark.parametrize("width", [5.0, 1e6])
def test_asof_join(spark, frame, rows, width):
    left = frame.filter("id % 2 = 0").select("k", "ts", F.col("id").alias("lid"))
    right = frame.filter("id % 2 = 1").select("k", "ts", "id", "v")
    got = {r["lid"]: (r["id"], r["v"]) for r in asof.asof_join(left, right, ["k"], "ts", "ts", ["id", "v"], ["id"], slice_seconds=width).collect()}
    want = {}
    for k, ts, i, _ in rows:
        if i % 2 == 0:
            hits = [(t, j, v) for kk, t, j, v in rows if kk == k and j % 2 == 1 and t <= ts]
            if hits:
                _, j, v = max(hits, key=lambda h: (h[0], h[1]))
                want[i] = (j, v)
    assert got == want
    kept = asof.asof_join(left, right, ["k"], "ts", "ts", ["id"], ["id"], how="left", slice_seconds=width)
    assert kept.count() == left.count()


def test_asof_legs_carries_empty_quotes_and_breaks_ties(spark):
    def at(s):
        return T0 + timedelta(seconds=s)

    rows = [
        ("g", at(0), at(0), 1, "a", 0.4),
        ("g", at(1), at(1), 2, "b", 0.5),
        ("g", at(9), at(9), 3, "a", None),  # the side empties and stays so
        ("g", at(12), at(13), 5, "b", 0.7),  # same event time, received later: wins
        ("g", at(12), at(12), 4, "b", 0.6),
        ("g", at(25), at(25), 6, "b", 0.8),
    ]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, recv timestamp_ntz, id bigint, leg string, price double")
    for width in (2.0, 10.0, 1e6):
        got = asof.asof_legs(df, ["g"], "ts", ["recv", "id"], "leg", ["a", "b"], ["price"], slice_seconds=width)
        seen = [(r["ts"], r["a"]["price"], r["b"]["price"]) for r in got.orderBy("ts").collect()]
        assert seen == [(at(1), 0.4, 0.5), (at(9), None, 0.5), (at(12), None, 0.7), (at(25), None, 0.8)]


@pytest.mark.parametrize("width", [7.0, 120.0, 3600.0])
def test_interval_join(spark, frame, rows, width):
    spans = [(k, T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + d), n) for n, (k, s, d) in enumerate(
        [("hot", 0, 60), ("hot", 30, 400), ("hot", 60, 0), ("k1", 10, 900), ("k2", 500, 1), ("none", 0, 9)])]
    df = spark.createDataFrame(spans, "k string, lo timestamp_ntz, hi timestamp_ntz, n int")
    got = sorted((r["id"], r["n"]) for r in intervals.interval_join(frame, df, ["k"], "ts", "lo", "hi", width).collect())
    want = sorted((r[2], n) for r in rows for k, lo, hi, n in spans if r[0] == k and lo <= r[1] < hi)
    assert got == want


def test_blackouts(spark, frame, rows):
    centers = [T0 + timedelta(seconds=s) for s in (0, 100, 103, 500.25, 990)]
    df = spark.createDataFrame([(c,) for c in centers], "c timestamp_ntz")
    for half in (0.25, 5.0, 40.0):
        got = {r["id"] for r in intervals.outside_blackouts(frame, "ts", df, "c", half).collect()}
        assert got == {r[2] for r in rows if all(abs((r[1] - c).total_seconds()) > half for c in centers)}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    data = {"hot": rng.lognormal(3, 4, 900), "even": rng.integers(0, 5, 100).astype(float), "one": np.array([4.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("none", None), (None, 2.0), (None, 3.0)], "k string, v double")
    data = {**data, None: np.array([2.0, 3.0])}
    got = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], "v", {"a": 0.0, "q": 0.9, "m": 0.5, "z": 1.0}).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k]["n"] == len(vs)
        for name, p in {"a": 0.0, "q": 0.9, "m": 0.5, "z": 1.0}.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12)


def test_keep_last_and_merge(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert sorted(map(tuple, latest.keep_last(df, ["k"], ["n"]).collect())) == [("a", 3, None), ("b", 1, "z")]
    assert sorted(map(tuple, latest.keep_first(df, ["k"], ["n"]).collect())) == [("a", 1, "x"), ("b", 1, "z")]
    live = spark.createDataFrame([("b", 9, "live")], "k string, n int, v string")
    merged = latest.merge_tiers([df, live], ["k"], ["n"])
    assert sorted(map(tuple, merged.collect())) == [("a", 3, None), ("b", 9, "live")]


def test_asof_left_keeps_rows_without_key_or_time(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, None, 5), (3, "k", None), (4, "z", 5)], "id int, k string, t int")
    left = left.selectExpr("id", "k", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, t) AS ts")
    right = spark.sql("SELECT 'k' AS k, timestamp_ntz'2026-01-01 00:00:01' AS rts, 9 AS v")
    got = asof.asof_join(left, right, ["k"], "ts", "rts", ["v"], how="left")
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, 9), (2, None), (3, None), (4, None)]
    assert [r.id for r in asof.asof_join(left, right, ["k"], "ts", "rts", ["v"]).collect()] == [1]


def test_interval_without_an_end(spark, frame, rows):
    """Cut at the last point, not listed up to the end of time."""
    spans = [("hot", T0 + timedelta(seconds=50), datetime(9999, 12, 31)), ("k1", datetime(1, 1, 1), datetime(9999, 12, 31))]
    df = spark.createDataFrame(spans, "k string, lo timestamp_ntz, hi timestamp_ntz")
    got = sorted(r["id"] for r in intervals.interval_join(frame, df, ["k"], "ts", "lo", "hi", 60.0).collect())
    assert got == sorted(r[2] for r in rows for k, lo, hi in spans if r[0] == k and lo <= r[1] < hi)
    assert intervals.interval_join(frame, df.limit(0), ["k"], "ts", "lo", "hi").count() == 0
    assert intervals.interval_join(frame.limit(0), df, ["k"], "ts", "lo", "hi").count() == 0


def test_long_intervals_are_listed_a_few_times(spark, frame, monkeypatch):
    listed = []
    monkeypatch.setattr(intervals, "materialize", lambda df: listed.append(df) or df)
    spans = [("hot", T0 - timedelta(days=1), T0 + timedelta(days=700)), ("hot", T0, T0 + timedelta(minutes=9)), ("k1", T0, T0 + timedelta(hours=4))]
    df = spark.createDataFrame(spans, "k string, lo timestamp_ntz, hi timestamp_ntz")
    joined = intervals.interval_join(frame, df, ["k"], "ts", "lo", "hi", 600.0)
    per_interval = [r["count"] for r in listed[0].groupBy("k", "lo").count().collect()]
    assert len(per_interval) == 3 and max(per_interval) <= intervals.STEP + 2
    points = frame.filter("k IN ('hot', 'k1')").count()
    assert points <= joined.count() <= 3 * points


def test_intervals_are_computed_once(spark, frame):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(n):
        seen.add(1)
        return n

    spans = [("hot", T0 + timedelta(seconds=n), T0 + timedelta(seconds=n + 60), n) for n in range(20)]
    df = spark.createDataFrame(spans, "k string, lo timestamp_ntz, hi timestamp_ntz, n int").withColumn("n", counted.asNondeterministic()("n"))
    joined = intervals.interval_join(frame, df.filter("n >= 0"), ["k"], "ts", "lo", "hi", 60.0)
    assert joined.filter("n < 0").count() == 0 and joined.count() > 0
    assert seen.value == len(spans)


def test_innings_follow_one_another_without_a_second_look(spark, monkeypatch):
    written = []
    monkeypatch.setattr(intervals, "materialize", lambda df: written.append(df) or df)
    at = lambda n: T0 + timedelta(minutes=n)
    plays = spark.createDataFrame(
        [(1, i, i, at(10 * i)) for i in (1, 2, 3, 5, 6)] + [(1, 9, 3, at(35)), (2, 1, None, at(1)), (2, 2, 1, at(2))],
        "game_pk int, at_bat_index int, inning int, start_time timestamp_ntz",
    )
    context = spark.createDataFrame([("t", 1, "home", "x", 1), ("u", 2, "home", "x", 1)], "ticker string, game_pk int, side string, team string, y int")
    trades = spark.createDataFrame([("t", at(m), 0.5) for m in (15, 25, 45, 55)], "ticker string, created_time timestamp_ntz, yes_price_dollars double")
    odds = plays.select("game_pk", "at_bat_index", F.lit(50.0).alias("home_wp"), F.lit(50.0).alias("away_wp"))
    got = snapshots.interval_snapshots(trades, context, plays, odds)
    assert sorted((r["ticker"], r["entering"], r["created_time"]) for r in got.collect()) == [("t", 2, at(15)), ("t", 3, at(25)), ("t", 6, at(55))]
    # the innings' starts are aggregated once
    assert written[0]._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_partitions_by_game_grow_with_the_line_items(spark, monkeypatch):
    monkeypatch.setattr(fx, "GAME_ROWS", 1_000)
    for sf in ("sf0.001", "sf0.01"):
        t = fx.Tables(spark, f"/root/testdata/{sf}")
        n = t.lineitem.count() // 1_000 + 1
        ended = snapshots.entering_probability(fx.win_probability(t), fx.plays(t))
        for df in (fx.plays(t), fx.win_probability(t), snapshots.interval_starts(fx.plays(t)), ended):
            assert df.rdd.getNumPartitions() == n
