import json

import pytest

from sparkodds.functions.tickers import team_dimension
from sparkodds.operators.quality import QualityError
from sparkodds.plans import refresh
from sparkodds.sources import sinks

E1, E2 = "KXMLBGAME-26APR301235STLPIT", "KXMLBGAME-26JUN301235STLPIT"


def raw(spark, winner="STL"):
    events = spark.createDataFrame([(e, "KXMLBGAME") for e in (E1, E2)], "event_ticker string, series_ticker string")
    rows = [(f"{E1}-{t}", E1, "finalized", "yes" if t == winner else "no", "2026-04-30T20:00:00Z") for t in ("STL", "PIT")]
    rows += [(f"{E2}-{t}", E2, "active", None, "2026-07-01T00:00:00Z") for t in ("STL", "PIT")]
    markets = spark.createDataFrame(rows, "ticker string, event_ticker string, status string, result string, close_time string")
    games = spark.createDataFrame(
        [(1, "2026-04-30T16:35:00Z", "2026-04-30", 138, 134, 1, True, False)],
        "game_pk bigint, game_date string, official_date string, away_team_id int, home_team_id int, game_number int,"
        " away_is_winner boolean, home_is_winner boolean",
    )
    plays = spark.createDataFrame([(1, "2026-04-30T19:40:00Z")], "game_pk bigint, end_time string")
    return events, markets, games, plays, team_dimension(spark)


def test_map_is_published_only_when_good(spark, tmp_path):
    path = str(tmp_path / "map")
    published = refresh.publish_map(*raw(spark), path, min_rate=0.5)
    assert [(r.event_ticker, r.game_pk, r.match_method) for r in published.collect()] == [(E1, 1, "date")]
    with pytest.raises(QualityError, match="match rate 50.00% below 99%"):
        refresh.publish_map(*raw(spark), path)
    with pytest.raises(QualityError, match="disagree"):
        refresh.publish_map(*raw(spark, winner="PIT"), path, min_rate=0.5)
    assert sinks.table(spark, path).count() == 1


TRADE = "struct<trade_id string, ticker string, count_fp string, created_time string, is_block_trade boolean>"
PAGES = f"ticker string, phase string, page int, is_last boolean, trades array<{TRADE}>"


def trade(i, ticker, count="1"):
    return (i, ticker, count, "2026-04-30T16:00:00Z", False)


def test_land_markets(spark, tmp_path):
    events, markets, *_ = raw(spark)
    old = markets.selectExpr("ticker", "event_ticker", "'active' AS status")
    for _ in range(2):  # a repeated run changes nothing
        refresh.land_markets(events, old, markets.filter(f"event_ticker = '{E1}'"), str(tmp_path))
    stored = {r.ticker: r.status for r in sinks.table(spark, f"{tmp_path}/markets").collect()}
    assert len(stored) == 4 and sorted(stored.values()) == ["active", "active", "finalized", "finalized"]
    with pytest.raises(QualityError, match="no rows in events"):
        refresh.land_markets(events.limit(0), old, markets, str(tmp_path))


def test_a_market_is_marked_when_its_trades_are_there(spark, tmp_path):
    path = str(tmp_path)
    events, markets, *_ = raw(spark)
    refresh.land_markets(events, markets.limit(0), markets, path)
    plan = refresh.plan_trades(spark, path, "r1", "2026-04-30T18:00:00Z")
    phases = {(r.ticker[-3:], r.phase, r.state) for r in plan.collect() if r.ticker.startswith(E1)}
    assert phases == {(t, p, "planned") for t in ("STL", "PIT") for p in ("historical", "live")}
    stl, pit, other = f"{E1}-STL", f"{E1}-PIT", f"{E2}-STL"
    pages = [
        (stl, "historical", 1, False, [trade("t1", stl, "1"), trade("t1", stl, "2")]), (stl, "historical", 2, True, [trade("t2", stl)]),
        (stl, "live", 1, True, []), (pit, "historical", 1, True, [trade("t3", pit)]), (pit, "live", 2, True, []),
        (other, "live", 1, True, []), (other, "historical", 1, True, []), ("unknown", "live", 1, True, []),
    ]
    states = refresh.land_trades(spark.createDataFrame(pages, PAGES), path, "r1")
    got = {(r.ticker, r.phase): (r.n_pages, r.state) for r in states.collect()}
    assert got[stl, "historical"] == (2, "complete") and got[stl, "live"] == (1, "complete")
    assert got[pit, "historical"] == (1, "complete") and got[pit, "live"] == (1, "landed")  # its first page is missing
    assert got[f"{E2}-PIT", "live"] == (0, "planned") and len(got) == 8

    def marked():
        return sorted(r.ticker for r in sinks.table(spark, f"{path}/kalshi_trade_pulls").collect())

    assert marked() == [stl]  # the other market is still active, the third isn't whole
    stored = {r.trade_id: r.count_fp for r in sinks.table(spark, f"{path}/trades").collect()}
    assert stored == {"t1": "2", "t2": "1", "t3": "1"}
    refresh.land_trades(spark.createDataFrame([(pit, "live", 1, False, [trade("t4", pit)])], PAGES), path, "r1")
    assert marked() == sorted([stl, pit])
    again = {r.ticker for r in refresh.plan_trades(spark, path, "r2", "2026-04-30T18:00:00Z").collect()}
    assert again == {f"{E2}-STL", f"{E2}-PIT"}


def test_last_item_of_the_pages_wins(spark, tmp_path):
    events, markets, *_ = raw(spark)
    place = "named_struct('_page', page, '_pos', pos) AS _order"
    repeats = spark.range(300).selectExpr(
        f"'{E1}-STL' AS ticker", f"'{E1}' AS event_ticker", "concat('s', id) AS status", "id div 10 AS page", "id % 10 AS pos"
    ).selectExpr("ticker", "event_ticker", "status", place).repartition(5)
    for _ in range(2):
        refresh.land_markets(events, repeats.limit(0), repeats, str(tmp_path))
    assert [r.status for r in sinks.table(spark, f"{tmp_path}/markets").collect()] == ["s299"]
    refresh.plan_trades(spark, str(tmp_path), "r", "2026-04-30T18:00:00Z")
    pages = [(f"{E1}-STL", "live", n + 1, n == 19, [trade("t", f"{E1}-STL", str(10 * n + i)) for i in range(10)]) for n in range(20)]
    refresh.land_trades(spark.createDataFrame(pages, PAGES).repartition(5), str(tmp_path), "r")
    assert [(r.count_fp, str(r.trade_date)) for r in sinks.table(spark, f"{tmp_path}/trades").collect()] == [("199", "2026-04-30")]


def test_land_games(spark, tmp_path):
    def game(pk, state):
        return {"gamePk": pk, "gameType": "R", "gameDate": "2026-04-30T16:35:00Z", "officialDate": "2026-04-30", "status": {"codedGameState": state}}

    pages = [(1, {"dates": [{"games": [game(1, "S"), game(2, "F")]}]}), (2, {"dates": [{"games": [game(1, "F")]}]})]
    schedules = spark.createDataFrame([(n, json.dumps(p)) for n, p in pages], "page int, payload string")
    plays = json.dumps({"allPlays": [{"about": {"atBatIndex": 0, "inning": 1}, "result": {"event": "Walk"}}]})
    odds = json.dumps([{"atBatIndex": 0, "homeTeamWinProbability": 51.5}])
    live = json.dumps({"gameData": {"weather": {"condition": "Clear", "temp": "70", "wind": "5 mph"}}})
    responses = spark.createDataFrame(
        [(1, False, plays, odds, live), (2, False, plays[:-9], '{"message": "x"}', None), (3, True, None, None, None)],
        "game_pk bigint, not_found boolean, plays string, win_probability string, live string",
    )
    for _ in range(2):
        refresh.land_games(schedules, responses, str(tmp_path))

    def table(name):
        return sinks.table(spark, f"{tmp_path}/{name}")

    assert sorted((r.game_pk, r.coded_game_state) for r in table("mlb_games").collect()) == [(1, "F"), (2, "F")]
    assert [(r.game_pk, r.event) for r in table("mlb_plays").collect()] == [(1, "Walk")]
    assert [(r.game_pk, r.home_wp) for r in table("mlb_win_probability").collect()] == [(1, 51.5)]
    assert [(r.game_pk, r.condition) for r in table("mlb_weather").collect()] == [(1, "Clear")]
    assert sorted((r.game_pk, r.not_found) for r in table("mlb_game_pulls").collect()) == [(1, False), (2, False), (3, True)]
    bad = [(r.game_pk, r.source, r.reason) for r in table("quarantine").collect()]
    assert sorted(set(bad)) == [(2, "plays", "malformed"), (2, "win_probability", "malformed")] and len(bad) == 4
