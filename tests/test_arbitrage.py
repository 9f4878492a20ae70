from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkodds.operators import books
from sparkodds.operators import episodes as ep
from sparkodds.plans import arbitrage
from sparkodds.schemas import table_schema
from sparkodds.sources import sinks
from sparkodds.streaming.books import stream_quotes

T0 = datetime(2026, 7, 30, 16, 0, 0)
EASTERN = timedelta(hours=-4)


def ms(t):
    return str(round((t - datetime(1970, 1, 1)).total_seconds() * 1000))


def snap(i, s, side, book, platform=None, source=True):
    at = T0 + timedelta(seconds=s)
    a = side in ("yes", "no")
    text = (ms(at) if a else at.isoformat() + "Z") if source else None
    return (i, at + EASTERN + timedelta(milliseconds=20), "kalshi" if a else "polymarket", "KA" if a else "slug", side, book, text)


def inputs(spark, snaps, meta=()):
    pair = [(1, date(2026, 7, 30), "TEX", "TB", "KA", "KH", "slug", "EV", "pev")]
    rows = [(i, e, "kalshi", t + EASTERN, None) for i, (e, t) in enumerate(meta)]
    return (
        spark.createDataFrame(snaps, table_schema("orderbook_snapshots")),
        spark.createDataFrame(pair, table_schema("matched_markets")),
        spark.createDataFrame(rows, table_schema("collection_metadata")),
    )


OPEN = [
    snap(1, 0, "yes", '[["0.40","9"],["0.45","100"]]'),
    snap(2, 0, "no", '[["0.50","50"]]'),  # ask 0.50
    snap(3, 0, "bids", '[["0.44","80"],["0.43","1"]]'),
    snap(4, 0, "offers", '[["0.49","30"],["0.60","1"]]'),
]
# the other venue's bid jumps over this venue's ask for two seconds
CROSS = [snap(5, 10, "bids", '[["0.48","80"]]'), snap(6, 10, "offers", '[["0.60","30"]]'),
         snap(7, 20, "bids", '[["0.58","70"]]'), snap(8, 22, "bids", '[["0.44","70"]]')]


def test_two_second_episode(spark):
    for width in (1.0, 15.0, 3600.0):
        a = arbitrage.build(*inputs(spark, OPEN + CROSS), slice_seconds=width)
        (e,) = a.episodes.collect()
        assert (e.start_ts, e.end_ts, e.duration_s) == (T0 + timedelta(seconds=20), T0 + timedelta(seconds=22), 2.0)
        assert (e.direction, e.n_states, e.bottleneck_liquidity, e.episode_id) == ("buy_kalshi", 1, 50.0, 1)
        assert e.game_key == "TEX@TB-2026-07-30"
        assert e.max_gross_arb == pytest.approx(0.08)
        assert e.max_net_arb == pytest.approx(0.08 - 0.07 * 0.25 - 0.06 * 0.58 * 0.42)


def test_blackout_in_local_time(spark):
    near, far = T0 + timedelta(seconds=50), T0 + timedelta(seconds=51)
    assert arbitrage.build(*inputs(spark, OPEN + CROSS, [("reconnect", near)])).episodes.count() == 0
    assert arbitrage.build(*inputs(spark, OPEN + CROSS, [("start", far)])).episodes.count() == 1
    assert arbitrage.build(*inputs(spark, OPEN + CROSS, [("stop", near)])).episodes.count() == 1


def test_cutoff_comes_before_looking_back(spark):
    early = [(*r[:1], r[1] - timedelta(days=30), *r[2:6], ms(T0 - timedelta(days=30))) for r in OPEN[:1]]
    early = [(50, *early[0][1:])]
    a = arbitrage.build(*inputs(spark, early + OPEN), since="2026-07-25", through="bbo")
    assert sorted(r["id"] for r in a.bbo.collect()) == [1, 2, 3, 4]


def test_changes_keep_emptied_sides_and_sizes(spark):
    rows = OPEN[:1] + [
        snap(10, 1, "yes", '[["0.45","100"]]'),  # best unchanged
        snap(11, 2, "yes", '[["0.45","60"]]'),  # size changes
        snap(12, 3, "yes", "[]"),  # side empties
        snap(13, 4, "yes", "[]"),
        snap(14, 5, "yes", '[["0.45","60"]]'),
        snap(15, 6, "yes", '[["0.99","1"]]', source=False),  # no source time: dropped
    ]
    snapshots, matched, _ = inputs(spark, rows)
    kept = books.bbo_changes(books.quotes(snapshots, matched), slice_seconds=2.0)
    assert [(r["id"], r["price"], r["size"]) for r in kept.orderBy("id").collect()] == [
        (1, 0.45, 100.0), (11, 0.45, 60.0), (12, None, None), (14, 0.45, 60.0)]
    assert books.missing_source_time(snapshots, "2026-07-25").first()["n_missing"] == 1


def test_empty_side_stops_states(spark):
    gone = [snap(20, 30, "offers", "[]"), snap(21, 40, "yes", '[["0.46","1"]]')]
    a = arbitrage.build(*inputs(spark, OPEN + CROSS + gone), through="states", slice_seconds=5.0)
    assert a.states.agg({"timestamp": "max"}).first()[0] == T0 + timedelta(seconds=22)


def test_open_ended_run_ends_at_its_last_state(spark):
    more = [snap(30, 21, "bids", '[["0.57","70"]]')]
    a = arbitrage.build(*inputs(spark, OPEN + CROSS[:3] + more), slice_seconds=0.7)
    (e,) = a.episodes.collect()
    assert (e.n_states, e.duration_s) == (2, 1.0)
    (single,) = arbitrage.build(*inputs(spark, OPEN + CROSS[:3])).episodes.collect()
    assert single.duration_s == 0.0


def test_stream_quotes_equal_batch_quotes(spark):
    snapshots, matched, _ = inputs(spark, OPEN + CROSS)
    stored = snapshots.withColumns({"source_ts": books.source_time(), "seq": F.col("id")})
    streamed = stream_quotes(stored, books.book_dimension(matched))
    batch = books.quotes(snapshots, matched).selectExpr("game_key", "update_type", "timestamp", "id AS seq", "price", "size")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_doubleheader_keys(spark):
    snapshots, matched, _ = inputs(spark, OPEN)
    assert books.quotes(snapshots, matched, key="event").select("game_key").distinct().first()[0] == "EV"


def test_written_tables(spark, tmp_path):
    arbitrage.build(*inputs(spark, OPEN + CROSS), path=str(tmp_path))
    info = sinks.table(spark, f"{tmp_path}/arb_build_info").first()
    assert (info.n_games, info.n_episodes, info.n_profitable, info.n_arb_states) == (1, 1, 1, 1)
    assert info.built_at is not None
    # a rebuild replaces
    arbitrage.build(*inputs(spark, OPEN), path=str(tmp_path))
    assert sinks.table(spark, f"{tmp_path}/arb_episodes").count() == 0
    assert ep.duration_buckets(sinks.table(spark, f"{tmp_path}/arb_episodes")).first()["s10p"] == 0
