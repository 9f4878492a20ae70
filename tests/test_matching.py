import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkodds.functions.tickers import team_dimension
from sparkodds.operators import matching
from sparkodds.operators.quality import QualityError

EVENT = "event_ticker string, n_suffixes bigint, suffix_a string, suffix_b string, settle_time timestamp_ntz, resolved_scalar boolean"
GAME = (
    "game_pk bigint, game_date timestamp_ntz, official_date date, away_team_id int, home_team_id int,"
    " game_number int, actual_end timestamp_ntz"
)
STL, PIT = 138, 134


def event(ticker, settle=None, a="PIT", b="STL", n=2, scalar=False):
    return (f"KXMLBGAME-{ticker}", n, a, b, settle, scalar)


def game(pk, when, number=1, hours=3.0, day=None, away=STL, home=PIT):
    end = when + timedelta(hours=hours) if hours else None
    return (pk, when, day or when.date(), away, home, number, end)


def resolve(spark, events, games):
    df = matching.resolve(
        spark.createDataFrame(events, EVENT), spark.createDataFrame(games, GAME), team_dimension(spark)
    )
    return {r["event_ticker"][len("KXMLBGAME-"):]: r for r in df.collect()}


NOON, EVENING = datetime(2026, 4, 30, 16, 35), datetime(2026, 4, 30, 22, 10)


@pytest.mark.parametrize(
    "ticker, settle, games, want",
    [
        ("26APR301235STLPIT", None, [game(1, NOON)], 1),
        ("26APR301235STLPIT", None, [game(1, NOON), game(2, EVENING)], 1),
        ("26APR301810STLPIT", None, [game(1, NOON), game(2, EVENING)], 2),
        ("26APR301235STLPIT", None, [game(1, datetime(2026, 5, 1, 16, 35))], None),
        ("25SEP24STLPIT", None, [game(1, datetime(2025, 9, 24, 23, 40))], 1),
        ("25APR26STLPITG1", None, [game(1, datetime(2025, 4, 26, 17), 1), game(2, datetime(2025, 4, 26, 22), 2)], 1),
        ("25APR26STLPITG2", None, [game(1, datetime(2025, 4, 26, 17), 1), game(2, datetime(2025, 4, 26, 22), 2)], 2),
        ("25APR26STLPIT", None, [game(1, datetime(2025, 4, 26, 17), 1), game(2, datetime(2025, 4, 26, 22), 2)], None),
        ("26APR301235STLPIT", None, [], None),
        ("25AUG18STLPITG2", None, [game(1, datetime(2025, 8, 18, 18, 20), 1)], None),
        # starts five minutes apart: the settlement decides
        ("26APR051340STLPIT", datetime(2026, 4, 5, 19, 55), [game(1, datetime(2026, 4, 5, 17, 10), 1, 2.5), game(2, datetime(2026, 4, 5, 17, 15), 2, 6.5)], 1),
        ("26APR051340STLPIT", datetime(2026, 4, 6, 0, 5), [game(1, datetime(2026, 4, 5, 17, 10), 1, 2.5), game(2, datetime(2026, 4, 5, 17, 15), 2, 6.5)], 2),
        # postponed: the make-up the settlement follows, night game first, nothing months later, none that ends after
        ("26APR291235STLPIT", datetime(2026, 5, 1, 1, 24), [game(1, NOON), game(2, datetime(2026, 4, 30, 21, 35))], 2),
        ("25APR18STLPIT", datetime(2026, 3, 25, 17, 33), [game(1, datetime(2025, 4, 18, 23, 5), day=date(2025, 4, 19))], None),
        ("26APR30STLPIT", datetime(2026, 5, 1, 1, 24), [game(1, datetime(2026, 5, 2, 16, 35))], None),
        ("26APR30STLPIT", datetime(2026, 5, 5, 1, 0), [game(1, datetime(2026, 5, 4, 20), hours=None)], None),
        # a start after midnight Eastern is listed on the date before
        ("26MAY010015STLPIT", None, [game(1, datetime(2026, 5, 1, 4, 15), day=date(2026, 4, 30))], 1),
    ],
)
def test_pick(spark, ticker, settle, games, want):
    # the schedule always has some other game, so an empty day is not an empty table
    other = game(99, datetime(2024, 6, 1, 17), away=110, home=111)
    assert resolve(spark, [event(ticker, settle)], [*games, other])[ticker]["game_pk"] == want


def test_reasons_and_outputs(spark):
    noon = game(1, NOON)
    got = resolve(
        spark,
        [
            event("26APR301235STLPIT"),
            event("26APR301236PITSTL"),
            event("26ZZZ301235STLPIT"),
            event("26APR301237STLPIT", a="CHC"),
            event("26APR301238STLQQQ", a="QQQ"),
            event("26JUN301235STLPIT", scalar=True),
            event("26JUN311235STLPIT"),
            event("26JUN291235STLPIT"),
            event("26APR302335STLPIT"),
            event("26APR301239STLPIT", n=3),
        ],
        [noon],
    )
    row = got["26APR301235STLPIT"]
    assert (row.game_pk, row.match_method, row.orientation_ok, row.start_delta_minutes) == (1, "date", True, 0.0)
    assert row.ticker_start_utc == "2026-04-30T16:35:00+00:00" and row.reason is None
    swapped = got["26APR301236PITSTL"]
    assert (swapped.game_pk, swapped.orientation_ok, swapped.start_delta_minutes) == (1, False, 1.0)
    reasons = {k: r.reason for k, r in got.items() if r.game_pk is None}
    assert reasons == {
        "26ZZZ301235STLPIT": "unparseable ticker",
        "26JUN311235STLPIT": "unparseable ticker",
        "26APR301237STLPIT": "pair STLPIT does not match its 2 suffixes",
        "26APR301239STLPIT": "pair STLPIT does not match its 3 suffixes",
        "26APR301238STLQQQ": "unknown team abbr in STL, QQQ",
        "26JUN301235STLPIT": "resolved scalar (cancelled game)",
        "26JUN291235STLPIT": "no schedule game on ticker date (postponed?)",
        "26APR302335STLPIT": "doubleheader ambiguous or start time out of tolerance",
    }


def test_gate(spark):
    report = spark.createDataFrame([(0, 0.98, 0)], "n_flipped int, match_rate double, n_disagree int")
    with pytest.raises(QualityError, match="below 99%"):
        matching.gate_match(report)
    matching.gate_match(report.withColumn("match_rate", F.lit(0.996)))


def test_listings_landed_twice(spark):
    a = spark.createDataFrame([("E", "2026-07-01", "STL", "PIT", "Ea", "Eh", None)] * 2, "event_ticker string, game_date string, away string, home string, away_ticker string, home_ticker string, start_utc timestamp_ntz")
    b = spark.createDataFrame([("s", "es", "2026-07-01", "STL", "PIT", None)] * 3, "slug string, event_slug string, game_date string, away string, home string, start_utc timestamp_ntz")
    assert [(r.poly_slug, r.kalshi_event_ticker) for r in matching.match_venues(a, b).collect()] == [("s", "E")]


def greedy(a, b):
    """Sequential reading of the cross-venue rule."""
    left = {}
    for e, day, away, home, start in sorted(a):
        left.setdefault((day, frozenset((away, home))), []).append((e, start))
    out = []
    for slug, day, away, home, start in sorted(b):
        cands = left.get((day, frozenset((away, home))), [])
        if not cands:
            continue
        if len(cands) == 1:
            chosen = cands[0]
        else:
            near = [c for c in cands if start and c[1] and abs((c[1] - start).total_seconds()) <= 6 * 3600]
            if not near:
                continue
            chosen = min(near, key=lambda c: (abs((c[1] - start).total_seconds()), c[0]))
        cands.remove(chosen)
        out.append((slug, chosen[0]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_match_venues_equals_sequential(spark, seed):
    rng = random.Random(seed)
    day = date(2026, 7, 30)

    def listings(prefix, n):
        out = []
        for i in range(n):
            away, home = rng.sample(["A", "B", "C", "D"], 2) if i % 3 else ("A", "B")
            start = None if rng.random() < 0.2 else datetime(2026, 7, 30, rng.randrange(24), rng.choice([0, 5]))
            out.append((f"{prefix}{i:03d}", day, away, home, start))
        return out

    a, b = listings("e", 60), listings("s", 70)
    dfa = spark.createDataFrame(a, "event_ticker string, game_date date, away string, home string, start_utc timestamp_ntz")
    dfb = spark.createDataFrame(b, "slug string, game_date date, away string, home string, start_utc timestamp_ntz")
    dfa = dfa.withColumns({"away_ticker": F.concat("event_ticker", F.lit("-a")), "home_ticker": F.concat("event_ticker", F.lit("-h"))})
    dfb = dfb.withColumn("event_slug", F.concat(F.lit("x"), "slug"))
    matched = matching.match_venues(dfa, dfb)
    assert sorted((r.poly_slug, r.kalshi_event_ticker) for r in matched.collect()) == greedy(a, b)
    rest = matching.unmatched_venues(dfa, dfb, matched)
    assert rest.count() == 130 - 2 * matched.count()


def test_a_crowded_pair_day_is_served_without_python(spark):
    """A thousand listings of one pair and day: each takes the nearest start that is left."""
    n, rng = 1000, random.Random(4)
    start = datetime(2026, 7, 30)
    events = [(f"E{i:05d}", date(2026, 7, 30), "NYY", "BOS", f"a{i}", f"h{i}", start + timedelta(seconds=rng.randrange(80_000)) if i % 50 else None) for i in range(n)]
    asks = [(f"s{i:05d}", "ev", date(2026, 7, 30), "BOS", "NYY", start + timedelta(seconds=rng.randrange(80_000)) if i % 40 else None) for i in range(n)]
    a = spark.createDataFrame(events, "event_ticker string, game_date date, away string, home string, away_ticker string, home_ticker string, start_utc timestamp_ntz")
    b = spark.createDataFrame(asks, "slug string, event_slug string, game_date date, away string, home string, start_utc timestamp_ntz")
    left, want = {e[0]: e[-1] for e in events}, []
    for slug, *_, at in asks:
        if len(left) == 1:
            chosen = next(iter(left))
        else:
            near = [(abs((s - at).total_seconds()), e) for e, s in left.items() if s and at and abs((s - at).total_seconds()) <= 6 * 3600]
            chosen = min(near)[1] if near else None
        if chosen:
            del left[chosen]
            want.append((slug, chosen))
    matched = matching.match_venues(a, b)
    assert sorted((r.poly_slug, r.kalshi_event_ticker) for r in matched.collect()) == want
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
