from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sparkodds.functions import fmt, stats
from sparkodds.functions import timefn as tf
from sparkodds.functions.books import top
from sparkodds.functions.tickers import (
    TEAM_IDS,
    date_prefix,
    game_key,
    pair_key,
    parse_event_ticker,
    slug_date,
    split_pair,
)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "ticker, start, day, pair, number",
    [
        ("KXMLBGAME-26APR301235STLPIT", datetime(2026, 4, 30, 16, 35), date(2026, 4, 30), "STLPIT", None),
        ("KXMLBGAME-25JUL041910WSHBOS", datetime(2025, 7, 4, 23, 10), date(2025, 7, 4), "WSHBOS", None),
        ("KXMLBGAME-25DEC011910WSHBOS", datetime(2025, 12, 2, 0, 10), date(2025, 12, 1), "WSHBOS", None),
        ("KXMLBGAME-25SEP24KCLAA", None, date(2025, 9, 24), "KCLAA", None),
        ("KXMLBGAME-25APR26BALDETG1", None, date(2025, 4, 26), "BALDET", 1),
        ("KXMLBGAME-25APR18MIAPHI2", None, date(2025, 4, 18), "MIAPHI", 2),
    ],
)
def test_ticker(spark, ticker, start, day, pair, number):
    got = one(spark, parse_event_ticker(F.lit(ticker)))
    assert (got.start_utc, got.et_date, got.pair, got.game_number) == (start, day, pair, number)


@pytest.mark.parametrize(
    "ticker",
    ["KXMLBGAME-26XXX301235STLPIT", "KXMLBGAME-26APR351235STLPIT", "KXNBAGAME-26APR301235STLPIT", "", "KXMLBGAME-26APR302460STLPIT"],
)
def test_malformed_ticker(spark, ticker):
    assert one(spark, parse_event_ticker(F.lit(ticker))) is None


@pytest.mark.parametrize(
    "pair, suffixes, want",
    [
        ("STLPIT", ["STL", "PIT"], ("STL", "PIT")),
        ("STLPIT", ["PIT", "STL"], ("STL", "PIT")),
        ("AZSTL", ["STL", "AZ"], ("AZ", "STL")),
        ("STLPIT", ["STL", "CHC"], None),
        ("STLPIT", ["STL"], None),
        ("STLPIT", ["STL", "PIT", "CHC"], None),
    ],
)
def test_split_pair(spark, pair, suffixes, want):
    got = one(spark, split_pair(F.lit(pair), F.array(*[F.lit(s) for s in suffixes])))
    assert (tuple(got) if got else None) == want


def test_names(spark):
    assert TEAM_IDS["ARI"] == TEAM_IDS["AZ"] == 109 and len(set(TEAM_IDS.values())) == 30
    assert one(spark, date_prefix(F.lit(date(2026, 7, 30)))) == "KXMLBGAME-26JUL30"
    assert one(spark, slug_date(F.lit("mlb-stl-pit-2026-07-30"))) == "2026-07-30"
    assert one(spark, game_key(F.lit("TEX"), F.lit("TB"), F.lit(date(2026, 7, 30)))) == "TEX@TB-2026-07-30"
    assert one(spark, pair_key(F.lit("B"), F.lit("A"))) == ["A", "B"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2026-07-24T23:25:21Z", datetime(2026, 7, 24, 23, 25, 21)),
        ("2026-07-24T23:25:21.123456Z", datetime(2026, 7, 24, 23, 25, 21, 123456)),
        ("2026-07-24T23:25:21+00:00", datetime(2026, 7, 24, 23, 25, 21)),
        ("2026-07-24T23:25:21-04:00", datetime(2026, 7, 25, 3, 25, 21)),
        ("2026-07-24T23:25:21", datetime(2026, 7, 24, 23, 25, 21)),
        ("2026-07-24 23:25:21", datetime(2026, 7, 24, 23, 25, 21)),
        ("2026-07-24", datetime(2026, 7, 24)),
        ("nonsense", None),
        (None, None),
    ],
)
def test_iso_in_any_session_zone(spark, text, want):
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert one(spark, tf.iso_to_utc(F.lit(text).cast("string"))) == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_naive_times_ignore_the_session_zone(spark):
    # 02:30 does not exist in New York that day
    gap = F.lit("2026-03-08 02:30:00").cast("timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, tf.micros(gap)) == 1772937000000000
        assert one(spark, tf.from_micros(tf.micros(gap))) == datetime(2026, 3, 8, 2, 30)
        assert one(spark, tf.elapsed_seconds(gap, F.lit("2026-03-08 03:30:00").cast("timestamp_ntz"))) == 3600.0
        assert one(spark, tf.epoch_ms_to_utc(F.lit("1772937000000"))) == datetime(2026, 3, 8, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_times(spark):
    def ts(text):
        return F.lit(text).cast("timestamp_ntz")

    # one minute boundary lies between, though only a second passes
    assert one(spark, tf.boundaries_between("minute", ts("2026-01-01 10:00:59"), ts("2026-01-01 10:01:00"))) == 1
    assert one(spark, tf.boundaries_between("minute", ts("2026-01-01 10:00:00"), ts("2026-01-01 10:00:59"))) == 0
    assert one(spark, tf.wall_to_utc(ts("2026-07-30 12:00:00"))) == datetime(2026, 7, 30, 16)
    assert one(spark, tf.wall_to_utc(ts("2026-01-30 12:00:00"))) == datetime(2026, 1, 30, 17)
    # the two venues' source times of one instant
    assert one(spark, tf.epoch_ms_to_utc(F.lit("1669149841000"))) == one(spark, tf.iso_to_utc(F.lit("2022-11-22T20:44:01Z")))
    assert one(spark, tf.elapsed_seconds(ts("2026-01-01 00:00:00"), ts("2026-01-01 00:00:02.5"))) == 2.5


def test_months(spark):
    bounds = spark.sql("SELECT DATE '2025-11-16' AS lo, DATE '2026-01-03' AS hi")
    got = [tuple(r) for r in tf.month_ranges(bounds).orderBy("from_date").collect()]
    assert got == [
        (date(2025, 11, 16), date(2025, 11, 30)),
        (date(2025, 12, 1), date(2025, 12, 31)),
        (date(2026, 1, 1), date(2026, 1, 3)),
    ]


def test_wilson(spark):
    lo, hi = stats.wilson(F.lit(0.0), F.lit(5))
    # no win in five, average price 1.6 cents
    assert round(one(spark, lo) - 0.016, 3) == -0.016
    assert round(one(spark, hi) - 0.016, 3) == 0.418


def test_fees_and_bands(spark):
    assert round(one(spark, stats.round_trip_fee(F.lit(0.5))), 6) == 0.0325
    assert [one(spark, stats.temp_band(F.lit(v))) for v in (59, 60, 79, 80)] == ["< 60°F", "60–69°F", "70–79°F", "80°F+"]
    assert one(spark, stats.wind_band(F.lit(None).cast("int"))) is None
    assert one(spark, stats.condition_group(F.lit("Overcast"))) == "clouds"
    assert one(spark, stats.condition_group(F.lit(None).cast("string"))) == "other"
    assert one(spark, stats.wind_mph(F.lit("8 mph, Out To CF"))) == 8
    assert one(spark, stats.wind_mph(F.lit("Calm"))) is None
    assert one(spark, stats.cents(F.lit("0.555").cast("decimal(18,6)"))) == 56
    assert [one(spark, stats.price_bucket(F.lit(p))) for p in (0.0, 0.1, 0.99, 1.0)] == [0, 1, 9, 9]


def test_formats(spark):
    assert one(spark, fmt.signed_cents(F.lit(-0.0001))) == "+0.0¢"
    assert one(spark, fmt.signed_cents(F.lit(0.012))) == "+1.2¢"
    assert one(spark, fmt.signed_cents(F.lit(-0.051))) == "-5.1¢"
    assert one(spark, fmt.count(F.lit(25_700_000))) == "25,700,000"
    assert one(spark, fmt.bucket_label(F.lit(2))) == "20–30¢"
    assert one(spark, fmt.secs(F.lit(1.26))) == "1.3s"
    assert one(spark, fmt.dollars(F.lit(56.159))) == "$56.16"


def test_top_of_book(spark):
    book = F.lit('[["0.30","5"],["0.31","7.5"]]')
    assert tuple(one(spark, top(book, "last"))) == (0.31, 7.5)
    assert tuple(one(spark, top(book, "first"))) == (0.30, 5.0)
    assert tuple(one(spark, top(F.lit("[]"), "last"))) == (None, None)


def test_large_amounts_are_plain_numbers(spark):
    row = spark.range(1).select(
        fmt.dollars(F.lit(12345678.9)).alias("a"), fmt.cents(F.lit(1234567.891)).alias("b"), fmt.percent(F.lit(None).cast("double")).alias("c"),
        fmt.signed_cents(F.lit(-0.0001)).alias("d"), fmt.signed_cents(F.lit(-2000000.5)).alias("e"),
    ).first()
    assert tuple(row) == ("$12345678.9", "123456789.1¢", None, "+0.0¢", "-200000050.0¢")


def test_a_ticker_makes_its_time_once(spark):
    df = spark.range(1).select(parse_event_ticker(F.lit("KXMLBGAME-26JUL301905NYYBOS")).alias("t"))
    assert df._jdf.queryExecution().analyzed().toString().count("try_make_timestamp_ntz(") == 1
