import json
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.sql import functions as F

from sparkodds import schemas
from sparkodds.operators import planning, quality
from sparkodds.operators.episodes import blackout_centers
from sparkodds.sources import landing, sinks, typed
from sparkodds.streaming import landing as streaming


def write(path, name, payload):
    path.mkdir(exist_ok=True)
    (path / name).write_text(payload if isinstance(payload, str) else json.dumps(payload))


def test_pages_from_files(spark, tmp_path):
    event = {"event_ticker": "E1", "series_ticker": "S", "title": "t", "category": "c"}
    write(tmp_path / "p", "1.json", {"events": [event, {**event, "event_ticker": "E2"}], "cursor": "x"})
    write(tmp_path / "p", "2.json", {"events": [{**event, "event_ticker": "E3", "sub_title": "s"}]})
    write(tmp_path / "p", "3.json", '{"events": [{"event_ticker"')
    pages = landing.read_json(spark, str(tmp_path / "p"), schemas.EVENT_PAGE)
    good, bad = landing.split_valid(pages.cache(), ["events"])
    assert sorted(r.event_ticker for r in landing.page_items(good, "events").collect()) == ["E1", "E2", "E3"]
    assert [r.reason for r in bad.collect()] == ["malformed"]


def test_nested_payloads_from_files(spark, tmp_path):
    play = {"about": {"atBatIndex": 0, "halfInning": "top", "inning": 1, "startTime": "2026-04-30T16:36:00Z"}, "result": {"event": "Walk"}}
    write(tmp_path / "g", "777.json", {"allPlays": [play]})
    files = landing.read_payloads(spark, str(tmp_path / "g")).withColumn(
        "game_pk", F.regexp_extract("path", r"(\d+)\.json", 1).cast("bigint")
    )
    (row,) = landing.plays(landing.parse(files, "payload", schemas.PLAY_BY_PLAY, ["game_pk"])).collect()
    assert (row.game_pk, row.event, row.end_time, row.inning) == (777, "Walk", None, 1)


def test_required_types_defaults_and_names(spark):
    df = spark.createDataFrame(
        [('{"gamePk": 1, "isWinner": true}',), ('{"gamePk": "x"}',), ('{"isWinner": false}',)], "payload string"
    )
    good, bad = landing.split_valid(landing.parse(df, "payload", "gamePk bigint, isWinner boolean"), ["gamePk"])
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "missing gamePk"]
    renamed = schemas.snake_columns(good)
    assert renamed.columns == ["game_pk", "is_winner"] and renamed.first().game_pk == 1
    assert landing.with_defaults(spark.createDataFrame([(None,)], "n int"), {"n": 7}).first().n == 7
    nested = spark.createDataFrame([('{"events":[{"startDate":"d","markets":[{"marketSides":[{"teamId":3}]}]}]}',)], "p string")
    events = landing.league_events(landing.parse(nested, "p", schemas.LEAGUE_EVENTS))
    assert events.select(F.col("markets")[0]["market_sides"][0]["team_id"]).first()[0] == 3


def test_faults_at_any_depth(spark):
    about = {"atBatIndex": 0, "inning": 1, "halfInning": "top"}
    payloads = [
        {"allPlays": [{"about": about, "result": {}}]},
        {"allPlays": [{"about": {"inning": 1, "halfInning": "top"}, "result": {}}, {"about": about}, None, {"result": {}}]},
        {}, {"allPlays": []}, {"allPlays": [{"about": {"atBatIndex": "x"}, "result": {}}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "game_pk int, payload string")
    found = landing.faults(landing.parse(df, "payload", schemas.PLAY_BY_PLAY, ["game_pk"]), "play_by_play", ["game_pk"])
    assert sorted(map(tuple, found.collect())) == [
        (1, "allPlays[]", "missing", 1), (1, "allPlays[].about", "missing", 1), (1, "allPlays[].about.atBatIndex", "missing", 1),
        (1, "allPlays[].result", "missing", 1), (2, "allPlays", "missing", 1), (4, "$", "malformed", 1)]


def test_upsert_table(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "id bigint, day date, v string"
    d1, d2 = date(2026, 7, 1), date(2026, 7, 2)
    sinks.upsert_table(spark.createDataFrame([(1, d1, "a"), (2, d1, "b"), (3, d2, "c")], ddl), path, ["id"], ["day"])
    sinks.upsert_table(spark.createDataFrame([("B", 2, d1), ("d", 4, d1)], "v string, id bigint, day date"), path, ["id"], ["day"])
    assert sorted((r.id, r.v) for r in sinks.table(spark, path).collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    with pytest.raises(ValueError, match="move between partitions"):
        sinks.upsert_table(spark.createDataFrame([(1, d2, "z")], ddl), path, ["id"], ["day"])
    # the same batch again changes nothing
    again = spark.createDataFrame([(2, d1, "B")], ddl)
    sinks.upsert_table(again, path, ["id"], ["day"])
    assert sinks.table(spark, path).count() == 4
    whole = str(tmp_path / "w")
    for v in ("x", "y"):
        sinks.upsert_table(spark.createDataFrame([(1, v)], "id bigint, v string"), whole, ["id"])
    assert [tuple(r) for r in sinks.table(spark, whole).collect()] == [(1, "y")]


def test_replace_keys_append_and_csv(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.replace_keys(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    sinks.replace_keys(spark.createDataFrame([("a", 3), ("a", 4)], "k string, v int"), path, "k")
    assert sorted(tuple(r) for r in sinks.table(spark, path).collect()) == [("a", 3), ("a", 4), ("b", 2)]
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append(spark.createDataFrame([("start", "kalshi")], "event string, platform string"), log)
    stored = spark.read.parquet(log).filter("timestamp IS NOT NULL")
    assert stored.count() == stored.select("id").distinct().count() == 2
    sinks.export_csv(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_stream_upsert(spark, tmp_path):
    log = streaming.LifecycleLog("kalshi")
    spark.streams.addListener(log)
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    for batch in ([(1, 1, "a"), (1, 2, "b")], [(1, 3, "c"), (2, 1, "x")]):
        spark.createDataFrame(batch, "id bigint, n int, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id bigint, n int, v string").parquet(source)
        streaming.upsert_stream(stream, path, str(tmp_path / "cp"), ["id"], ["n"]).awaitTermination()
    assert sorted(tuple(r) for r in sinks.table(spark, path).collect()) == [(1, 3, "c"), (2, 1, "x")]
    for _ in range(50):
        if len(log.rows) >= 4:
            break
        time.sleep(0.2)
    spark.streams.removeListener(log)
    metadata = log.frame(spark)
    assert sorted(r.event for r in metadata.collect()) == ["start", "start", "stop", "stop"]
    assert blackout_centers(metadata, zone="UTC").count() == 2


def test_typed_views_and_registry(spark):
    raw = spark.createDataFrame([("t1", "K", "3.00", "0.45", "0.55", "yes", "ask", "2026-07-24T23:25:21.5Z", False)], schemas.table_schema("trades"))
    typed.register_views({"trades": raw})
    row = spark.sql("SELECT * FROM trades_typed").first()
    assert str(row.yes_price_dollars) == "0.450000" and row.created_time.microsecond == 500000
    assert quality.tables_missing(spark, ["trades", "trades_typed", "nothing"]) == ["nothing"]
    widened = schemas.add_columns(raw, {"extra": "int", "ticker": "string"})
    assert widened.columns[-1] == "extra" and widened.first().extra is None
    assert schemas.conform(spark.createDataFrame([("T", "t9")], "ticker string, trade_id string"), "trades").first().trade_id == "t9"
    assert schemas.required_columns("markets") == ["ticker", "event_ticker", "status"]


def test_planning(spark):
    markets = spark.createDataFrame(
        [("new", None, None), ("old", "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"), ("both", "2026-01-01T00:00:00Z", "2026-09-01T00:00:00Z"),
         ("late", "2026-08-01T00:00:00Z", "2026-09-01T00:00:00Z"), ("done", None, None)],
        "ticker string, open_time string, close_time string",
    )
    trades = spark.createDataFrame([("both", "2026-08-05T00:00:00.9Z")], "ticker string, created_time string")
    done = spark.createDataFrame([("done",)], "ticker string")
    plan = {r.ticker: (r.min_ts, r.historical, r.live) for r in planning.trade_plan(markets, trades, done, "2026-07-01T00:00:00Z").collect()}
    assert plan == {"new": (None, True, True), "old": (None, True, False), "both": (1785887999, False, True), "late": (None, False, True)}
    ranges = planning.schedule_ranges(spark, date(2025, 5, 25)).orderBy("from_date").collect()
    assert [(r.from_date, r.to_date) for r in ranges] == [
        (date(2025, 4, 16), date(2025, 4, 30)), (date(2025, 5, 1), date(2025, 5, 31)), (date(2025, 6, 1), date(2025, 6, 4))]


def test_gates(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.0, 0.0)], "yes_price_dollars double, no_price_dollars double")
    bad = quality.violations(df, {"range": F.col("yes_price_dollars") >= 1, "sum": F.col("yes_price_dollars") + F.col("no_price_dollars") != 1})
    with pytest.raises(quality.QualityError, match="range: 1"):
        quality.gate(bad)
    quality.gate(bad.filter("check = 'sum'"))
    with pytest.raises(quality.QualityError, match="no rows in events"):
        quality.require_rows(spark.range(0), "events")


def test_counted_while_written(spark):
    rows = spark.range(100).select((F.col("id") % 10).alias("v"))
    checks = {"nines": F.col("v") == 9, "negative": F.col("v") < 0}
    stored, found = quality.written(rows, checks, top=F.max("v"))
    assert found == {"n_rows": 100, "nines": 10, "negative": 0, "top": 9} and stored.count() == 100
    with pytest.raises(quality.QualityError, match="^nines: 10$"):
        quality.gate_counts(found, checks)
    for empty in (spark.range(0), spark.range(9).filter("id > 9"), rows.limit(0), rows.join(rows.filter("false"), "v")):
        assert quality.written(empty)[1] == {"n_rows": 0}
    with pytest.raises(quality.QualityError, match="no rows in games"):
        quality.written_rows(spark.range(0), "games")
    with pytest.raises(quality.QualityError, match="100 rows in games, not 101"):
        quality.written_rows(rows, "games", 101)
    assert quality.written_rows(rows.repartition(7), "games", 100).count() == 100


def test_partitions_keep_their_type_and_null(spark, tmp_path):
    """Text that looks like a number, and no value at all, in many partitions."""
    path, ddl = str(tmp_path / "t"), "id bigint, p string, v string"
    rows = [(1, "0123", "old"), (2, None, "stays"), (3, "0007", "stays")] + [(10 + i, f"{i:04d}", "x") for i in range(30)]
    sinks.upsert_table(spark.createDataFrame(rows, ddl), path, ["id"], ["p"])
    sinks.upsert_table(spark.createDataFrame([(1, "0123", "new"), (4, None, "added")], ddl), path, ["id"], ["p"])
    stored = sinks.stored_table(spark, path, spark.createDataFrame([], ddl), ["p"])
    got = {r.id: (r.p, r.v) for r in stored.collect()}
    assert stored.count() == len(got) == 34
    assert got[1] == ("0123", "new") and got[2] == (None, "stays") and got[3] == ("0007", "stays") and got[4] == (None, "added")
    sinks.replace_keys(spark.createDataFrame([(1, "0123", "a"), (1, "0123", "b")], ddl), path, "id", ["p"])
    assert sorted(r.v for r in sinks.stored_table(spark, path, stored, ["p"]).filter("p = '0123'").collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="v is stored as string"):
        sinks.upsert_table(spark.createDataFrame([(1, "0123", 5)], "id bigint, p string, v int"), path, ["id"], ["p"])


def test_last_of_one_batch_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, i, f"v{i}") for i in range(200)]
    for _ in range(2):
        sinks.upsert_table(spark.createDataFrame(rows, "id bigint, _order int, v string").repartition(7), path, ["id"], order=["_order"])
    assert [tuple(r) for r in sinks.table(spark, path).collect()] == [(1, "v199")]


def test_a_writer_that_dies_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    before = sinks.rebuild(spark.range(5), path, view="kept")
    boom = spark.range(5).select(F.expr("id div 0 AS id"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        sinks.rebuild(boom, path, view="kept")
    assert sinks.table(spark, path).count() == spark.table("kept").count() == 5
    # a reader keeps the version that it began with
    sinks.rebuild(spark.range(7), path, view="kept")
    assert (before.count(), sinks.table(spark, path).count(), spark.table("kept").count()) == (5, 7, 7)
    sinks.rebuild(spark.range(9), path, view="kept")
    assert sinks.drop_versions(spark, path, keep=2) == 1 and len(sinks.versions(spark, path)) == 2
    assert sinks.table(spark, path).count() == 9
    spark.sql("DROP VIEW kept")
    with pytest.raises(FileNotFoundError):
        sinks.table(spark, str(tmp_path / "nothing"))


def test_appenders_share_no_ids(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(50).selectExpr("id AS n").repartition(3)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: sinks.append(rows, path), range(4)))
    sinks.append(spark.range(1).selectExpr("-1L AS n"), path)
    stored = sinks.table(spark, path)
    ids = [r.id for r in stored.select("id").collect()]
    assert len(set(ids)) == 201
    assert stored.orderBy(F.desc("id")).first().n == -1  # the last one is above the others
    sinks.append(spark.range(0).selectExpr("id AS n"), path)
    assert sinks.table(spark, path).count() == 201


@pytest.mark.parametrize("partitions", [[], ["p"]])
def test_added_columns_survive(spark, tmp_path, partitions):
    path = str(tmp_path / "t")
    for rows, ddl in (
        ([(1, "a")], "id bigint, p string"),
        ([(2, "b", "new")], "id bigint, p string, c string"),
        ([(3, "b")], "id bigint, p string"),
        ([(4, "a", 0.5)], "id bigint, p string, d double"),
        ([(5, "x")], "id bigint, p string"),
    ):
        sinks.upsert_table(spark.createDataFrame(rows, ddl), path, ["id"], partitions)
    got = {r.id: (r.p, r.c, r.d) for r in sinks.table(spark, path).collect()}
    assert got == {1: ("a", None, None), 2: ("b", "new", None), 3: ("b", None, None), 4: ("a", None, 0.5), 5: ("x", None, None)}
    sinks.replace_keys(spark.createDataFrame([(2, "b")], "id bigint, p string"), path, "id", partitions)
    assert {r.id: r.d for r in sinks.table(spark, path).collect()}[4] == 0.5
    assert set(sinks.table(spark, path).columns) == {"id", "p", "c", "d"}


def test_array_payloads_are_quarantined(spark):
    item = '{"atBatIndex": 0, "homeTeamWinProbability": 51.5}'
    rows = [(1, f"[{item}]"), (2, '{"message": "x"}'), (3, f"[{item}, {{"), (4, '[{"homeTeamWinProbability": 1}]'), (5, "[]")]
    good, bad = landing.win_probability_split(spark.createDataFrame(rows, "game_pk bigint, payload string"))
    assert [(r.game_pk, r.at_bat_index, r.home_wp) for r in good.collect()] == [(1, 0, 51.5)]
    assert sorted((r.game_pk, r.reason) for r in bad.collect()) == [(2, "malformed"), (3, "malformed"), (4, "missing atBatIndex")]


def test_json_is_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"allPlays": [{"about": {"atBatIndex": 0}}]}')], "game_pk bigint, payload string")
    plan = landing.plays(landing.parse(df, "payload", schemas.PLAY_BY_PLAY, ["game_pk"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_broken_stream_lines_are_kept(spark, tmp_path):
    write(tmp_path / "in", "1.json", '{"type": "error"}\n{"type": "orderb')
    raw = streaming.read_messages(spark, str(tmp_path / "in"), schemas.BOOK_MESSAGE)
    out = str(tmp_path / "bad")
    streaming.append_table(landing.unreadable(raw), out, str(tmp_path / "cp")).awaitTermination()
    assert [(r.reason, r.line) for r in spark.read.parquet(out).collect()] == [("malformed", '{"type": "orderb')]
