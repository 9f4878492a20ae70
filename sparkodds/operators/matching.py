"""Entity resolution between sources that share no key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkodds.functions.tickers import (
    EVENT_PATTERN,
    NON_GAME_SUFFIXES,
    SERIES,
    market_suffix,
    parse_event_ticker,
    slug_date,
    split_pair,
)
from sparkodds.functions.timefn import iso_to_utc, micros, seconds
from sparkodds.operators.quality import MIN_MATCH_RATE, QualityError
from sparkodds.operators.snapshots import one_row
from sparkodds.operators.latest import keep_first
from sparkodds.operators.unions import union
from sparkodds.session import materialize

# Tolerances of the match.
START_TOLERANCE_SECONDS = 6 * 3600
SETTLEMENT_WINDOW_SECONDS = 24 * 3600
MAKEUP_MAX_DAYS = 200
DATE_OFFSETS = [0, -1, 1]


def load_events(events: DataFrame, markets: DataFrame, series: str = SERIES) -> DataFrame:
    """Game events of a series: their two market suffixes, when they settled (only
    markets that resolved yes or no count) and whether any resolved scalar.

    Two suffixes are fully described by their count, least and greatest, so no
    list of a group's markets is built."""
    decided = (F.col("status") == "finalized") & F.col("result").isin("yes", "no")
    named = markets.select(
        "event_ticker",
        market_suffix("ticker").alias("_suffix"),
        F.when(decided, F.col("close_time")).alias("_close"),
        (F.col("result") == "scalar").alias("_scalar"),
    )
    return (
        named.join(events.filter(F.col("series_ticker") == series).select("event_ticker"), "event_ticker")
        .groupBy("event_ticker")
        .agg(
            F.countDistinct("_suffix").alias("n_suffixes"),
            F.min("_suffix").alias("suffix_a"),
            F.max("_suffix").alias("suffix_b"),
            F.max("_close").alias("_settle"),
            F.coalesce(F.bool_or("_scalar"), F.lit(False)).alias("resolved_scalar"),
            F.bool_or(F.col("_suffix").isin(*NON_GAME_SUFFIXES)).alias("_not_game"),
        )
        .filter("NOT _not_game")
        .select(
            "event_ticker",
            "n_suffixes",
            "suffix_a",
            "suffix_b",
            iso_to_utc("_settle").alias("settle_time"),
            "resolved_scalar",
        )
    )


def load_games(games: DataFrame, plays: DataFrame) -> DataFrame:
    """Schedule rows with typed times and the end of their last play (the
    greatest end time as text, as stored)."""
    ends = plays.groupBy("game_pk").agg(iso_to_utc(F.max("end_time")).alias("actual_end"))
    return games.select(
        "game_pk",
        iso_to_utc("game_date").alias("game_date"),
        F.col("official_date").cast("date").alias("official_date"),
        "away_team_id",
        "home_team_id",
        "game_number",
    ).join(ends, "game_pk", "left")


def _low_high(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")]


def within_settlement(end: Column | str, settle: Column | str) -> Column:
    """The market settled at or after the game's end, at most a window later."""
    end = F.col(end) if isinstance(end, str) else end
    settle = F.col(settle) if isinstance(settle, str) else settle
    return (end <= settle) & (settle <= end + seconds(SETTLEMENT_WINDOW_SECONDS))


def settled_on(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Per group the candidate that ended last before its settlement."""
    return (
        candidates.filter(within_settlement("actual_end", "settle_time"))
        .groupBy(*by)
        .agg(F.max_by("game", F.struct("actual_end", -F.col("game.game_pk"))).alias("game"))
    )


def pick_game(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Choose a game per group of candidates.

    Candidate rows hold ``game`` (a struct with game_pk), ``n`` (games it stands
    for), game_date, game_number, actual_end, and the ticker's start_utc,
    ticker_number and settle_time. In this order: the ticker's game number and
    the start tolerance filter; a single candidate wins; else the one the
    settlement follows; else the nearest start. One aggregate, no lists.
    """
    gap = F.abs(micros("game_date") - micros("start_utc"))
    kept = candidates.filter(
        (F.col("ticker_number").isNull() | (F.col("game_number") == F.col("ticker_number")))
        & (F.col("start_utc").isNull() | (gap <= START_TOLERANCE_SECONDS * 1_000_000))
    )
    settled = within_settlement("actual_end", "settle_time")
    earlier_pk = -F.col("game.game_pk")
    choice = kept.groupBy(*by).agg(
        F.sum("n").alias("_n"),
        F.min_by("game", F.col("game.game_pk")).alias("_only"),
        F.max_by(F.when(settled, F.col("game")), F.when(settled, F.struct("actual_end", earlier_pk))).alias(
            "_settled"
        ),
        F.min_by("game", F.struct(gap, "game.game_pk")).alias("_nearest"),
        F.bool_or(F.col("start_utc").isNotNull()).alias("_timed"),
    )
    game = F.when(F.col("_n") == 1, F.col("_only")).otherwise(
        F.coalesce("_settled", F.when(F.col("_timed"), F.col("_nearest")))
    )
    return choice.select(*by, game.alias("game")).filter("game IS NOT NULL")


def parsed_events(events: DataFrame, teams: DataFrame, pattern: str = EVENT_PATTERN) -> DataFrame:
    """Events with parsed ticker, ordered sides and team ids, and the reason why
    an event cannot be looked up at all (NULL when it can)."""
    away = teams.select(F.col("abbr").alias("away_abbr"), F.col("team_id").alias("away_team_id"))
    home = teams.select(F.col("abbr").alias("home_abbr"), F.col("team_id").alias("home_team_id"))
    suffixes = F.when(F.col("n_suffixes") == 2, F.array("suffix_a", "suffix_b"))
    parsed = (
        events.withColumn("_t", parse_event_ticker("event_ticker", pattern))
        .withColumn("_sides", split_pair("_t.pair", suffixes))
        .select(
            *events.columns,
            F.col("_t").isNotNull().alias("_parsed"),
            F.col("_t.start_utc").alias("start_utc"),
            F.col("_t.et_date").alias("et_date"),
            F.col("_t.pair").alias("pair"),
            F.col("_t.game_number").alias("ticker_number"),
            F.col("_sides.away").alias("away_abbr"),
            F.col("_sides.home").alias("home_abbr"),
        )
    )
    reason = (
        F.when(~F.col("_parsed"), "unparseable ticker")
        .when(
            F.col("away_abbr").isNull(),
            F.concat(F.lit("pair "), F.col("pair"), F.lit(" does not match its "),
                     F.col("n_suffixes").cast("string"), F.lit(" suffixes")),
        )
        .when(
            F.col("away_team_id").isNull() | F.col("home_team_id").isNull(),
            F.concat(F.lit("unknown team abbr in "), F.col("away_abbr"), F.lit(", "), F.col("home_abbr")),
        )
    )
    return (
        parsed.join(away, "away_abbr", "left").join(home, "home_abbr", "left")
        .withColumn("reason", reason).drop("_parsed")
    )


def resolve(events: DataFrame, games: DataFrame, teams: DataFrame, pattern: str = EVENT_PATTERN) -> DataFrame:
    """Every event with its game or the reason it has none.

    ``events`` as from ``load_events``, ``games`` as from ``load_games``.
    Lookups are equi-joins on (date, team pair). Games and events that look the
    same to the match are merged before they meet, so copies do not multiply.
    """
    looks = ["_lo", "_hi", "et_date", "start_utc", "ticker_number", "settle_time"]
    sided = parsed_events(events, teams, pattern).withColumns(
        {"_lo": F.least("away_team_id", "home_team_id"), "_hi": F.greatest("away_team_id", "home_team_id")}
    )
    # the look as one non-NULL text, so that it joins back on equality
    listed = materialize(sided.withColumn("_look", F.to_json(F.struct(*looks))))
    asked = listed.filter("reason IS NULL").select(*looks, "_look").distinct()

    pair_games = games.select(*games.columns, *_low_high("away_team_id", "home_team_id"))
    game = F.struct("game_pk", "away_team_id", "home_team_id", "game_date")
    merged = materialize(
        pair_games.groupBy("_lo", "_hi", "official_date", "game_date", "game_number", "actual_end").agg(
            F.min_by(game, "game_pk").alias("game"), F.count(F.lit(1)).alias("n")
        )
    )

    # the first offset whose date has any game of the pair
    offsets = F.when(F.col("start_utc").isNotNull(), F.array(*[F.lit(o) for o in DATE_OFFSETS])).otherwise(
        F.array(F.lit(0))
    )
    days = merged.select("_lo", "_hi", F.col("official_date").alias("_day")).distinct()
    dated = materialize(
        asked.select("*", F.posexplode(offsets).alias("_rank", "_offset"))
        .withColumn("_day", F.date_add("et_date", F.col("_offset")))
        .join(days, ["_lo", "_hi", "_day"])
        .groupBy("_look")
        .agg(F.min_by("_day", "_rank").alias("official_date"))
    )
    by_date = asked.join(dated, "_look").join(merged, ["_lo", "_hi", "official_date"])
    picked = materialize(pick_game(by_date, ["_look"]).withColumn("match_method", F.lit("date")))

    # postponed games: the market settles shortly after its make-up game, found by
    # the day that game ended
    day_of = lambda c: F.floor(micros(c) / F.lit(86_400_000_000.0)).cast("bigint")
    unsettled = (
        asked.filter("settle_time IS NOT NULL")
        .join(picked.select("_look"), "_look", "left_anti")
        .withColumn("_end_day", F.explode(F.array(day_of("settle_time"), day_of("settle_time") - 1)))
    )
    makeup = settled_on(
        unsettled.join(
            merged.filter("actual_end IS NOT NULL").withColumn("_end_day", day_of("actual_end")),
            ["_lo", "_hi", "_end_day"],
        ).filter(
            F.col("official_date").between(F.col("et_date"), F.date_add("et_date", MAKEUP_MAX_DAYS))
        ),
        ["_look"],
    ).withColumn("match_method", F.lit("settlement"))

    found = union(picked, makeup)
    outcome = (
        listed.join(found, "_look", "left")
        .join(dated.withColumnRenamed("official_date", "_had_date"), "_look", "left")
    )
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(
        F.col("game").isNull(),
        F.when(F.col("resolved_scalar"), "resolved scalar (cancelled game)")
        .when(F.col("_had_date").isNull(), "no schedule game on ticker date (postponed?)")
        .otherwise("doubleheader ambiguous or start time out of tolerance"),
    )
    has = F.col("reason").isNull() & F.col("game").isNotNull()
    return outcome.select(
        "event_ticker",
        F.when(has, F.col("game.game_pk")).alias("game_pk"),
        "away_abbr",
        "home_abbr",
        "away_team_id",
        "home_team_id",
        F.concat(F.replace(F.col("start_utc").cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00")).alias(
            "ticker_start_utc"
        ),
        F.when(
            has,
            (F.col("game.away_team_id") == F.col("away_team_id"))
            & (F.col("game.home_team_id") == F.col("home_team_id")),
        ).alias("orientation_ok"),
        F.when(
            has, F.abs(micros("game.game_date") - micros("start_utc")) / F.lit(60e6)
        ).alias("start_delta_minutes"),
        F.when(has, F.col("match_method")).alias("match_method"),
        reason.alias("reason"),
    )


def event_map(resolved: DataFrame) -> DataFrame:
    return resolved.filter("game_pk IS NOT NULL").drop("reason")


def unmatched(resolved: DataFrame) -> DataFrame:
    return resolved.filter("game_pk IS NULL").select("event_ticker", "reason")


def result_agreement(markets: DataFrame, mapping: DataFrame, games: DataFrame) -> DataFrame:
    """One row: finalized markets that agree, or not, with the schedule's winner
    (by team id, since a make-up game may swap venues)."""
    decided = markets.filter((F.col("status") == "finalized") & F.col("result").isin("yes", "no")).select(
        "event_ticker", "ticker", "result"
    )
    sides = mapping.select(
        "event_ticker", "game_pk", "away_abbr",
        F.col("away_team_id").alias("_away"), F.col("home_team_id").alias("_home"),
    )
    winners = games.filter("away_is_winner IS NOT NULL AND home_is_winner IS NOT NULL").select(
        "game_pk", F.when(F.col("away_is_winner"), F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("_won")
    )
    named = F.when(market_suffix("ticker") == F.col("away_abbr"), F.col("_away")).otherwise(F.col("_home"))
    ok = (F.col("result") == "yes") == (named == F.col("_won"))
    return (
        decided.join(sides, "event_ticker").join(winners, "game_pk").select(ok.alias("ok"))
        .agg(F.count_if("ok").alias("n_agree"), F.count_if(~F.col("ok")).alias("n_disagree"))
    )


def match_report(resolved: DataFrame, markets: DataFrame, games: DataFrame) -> DataFrame:
    """One row: totals, match rate, methods, shared games, flipped sides, agreement."""
    by_date = F.col("match_method") == "date"
    totals = resolved.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count("game_pk").alias("n_matched"),
        F.count_if(by_date).alias("n_by_date"),
        F.count_if(F.col("match_method") == "settlement").alias("n_by_settlement"),
        F.count_if(by_date & ~F.col("orientation_ok")).alias("n_flipped"),
    )
    shared = (
        event_map(resolved).groupBy("game_pk").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        .agg(F.count(F.lit(1)).alias("n_shared_games"))
    )
    agreement = result_agreement(markets, event_map(resolved), games)
    return one_row(totals, shared, agreement).withColumn(
        "match_rate",
        F.when(F.col("n_events") > 0, F.col("n_matched") / F.col("n_events")).otherwise(0.0),
    )


def match_problems(report: DataFrame, min_rate: float = MIN_MATCH_RATE) -> DataFrame:
    """(measure, found) of a match report that keep it from being published."""
    bad = {
        "n_flipped": F.col("n_flipped") > 0,
        "match_rate": F.col("match_rate") < min_rate,
        "n_disagree": F.col("n_disagree") > 0,
    }
    rows = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("found"), b.alias("_bad")) for c, b in bad.items()]
    return report.select(F.inline(F.array(*rows))).filter("_bad").drop("_bad")


def gate_match(report: DataFrame, min_rate: float = MIN_MATCH_RATE) -> None:
    """Raise when the match is not good enough to publish."""
    say = {
        "n_flipped": "{:.0f} events violate the away-then-home order",
        "match_rate": "match rate {:.2%} below " + f"{min_rate:.0%}",
        "n_disagree": "{:.0f} finalized markets disagree with the schedule's winner",
    }
    problems = [say[r["measure"]].format(r["found"]) for r in match_problems(report, min_rate).collect()]
    if problems:
        raise QualityError("; ".join(problems))


# Cross-venue matching


def venue_a_sides(events: DataFrame, markets: DataFrame, teams: DataFrame, pattern: str = EVENT_PATTERN) -> DataFrame:
    """Events whose markets name exactly two known teams that spell the ticker's
    pair: away and home labels and tickers, and the start when the ticker has one."""
    known = (
        markets.withColumn("abbr", F.substring_index("ticker", "-", -1))
        .join(teams.select("abbr").distinct(), "abbr", "left_semi")
        .groupBy("event_ticker")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct("abbr", "ticker")).alias("_a"),
            F.max(F.struct("abbr", "ticker")).alias("_b"),
        )
        .filter("_n = 2")
    )
    parsed = events.select("event_ticker", parse_event_ticker("event_ticker", pattern).alias("_t"))
    pair = F.col("_t.pair")
    forward = pair == F.concat("_a.abbr", "_b.abbr")
    backward = pair == F.concat("_b.abbr", "_a.abbr")
    away = F.when(forward, F.col("_a")).when(backward, F.col("_b"))
    home = F.when(forward, F.col("_b")).when(backward, F.col("_a"))
    return (
        parsed.join(known, "event_ticker").filter(forward | backward)
        .select("event_ticker", away.alias("_away"), home.alias("_home"), F.col("_t.et_date").alias("game_date"),
                F.col("_t.start_utc").alias("start_utc"))
        .select(
            "event_ticker",
            "game_date",
            F.col("_away.abbr").alias("away"),
            F.col("_home.abbr").alias("home"),
            F.col("_away.ticker").alias("away_ticker"),
            F.col("_home.ticker").alias("home_ticker"),
            "start_utc",
        )
    )


# Market type and league of the other venue's listings.
MONEYLINE_TYPE, LEAGUE = "baseball_team_full_game_winner", "mlb"


def venue_b_moneylines(events: DataFrame, day: str | None = None) -> DataFrame:
    """Moneyline markets of nested league events: away and home labels by the
    sides' ordering, start with fallback to the event's. ``day`` keeps slugs that
    end in that date; every slug must end in some date."""
    market = F.col("m")

    def label(ordering: str) -> Column:
        teams = F.transform(market["market_sides"], lambda s: s["team"])
        hits = F.filter(teams, lambda t: (t["league"] == LEAGUE) & (t["ordering"] == ordering))
        team = F.try_element_at(hits, F.lit(-1))
        return F.coalesce(F.nullif(team["display_abbreviation"], F.lit("")), F.upper(team["abbreviation"]))

    dated = events.withColumn("game_date", slug_date("slug").try_cast("date")).filter("game_date IS NOT NULL")
    if day is not None:
        dated = dated.filter(F.col("game_date") == F.lit(day).cast("date"))
    return (
        dated.select(F.col("slug").alias("event_slug"), "game_date", "start_date", F.explode("markets").alias("m"))
        .filter(market["sports_market_type"] == MONEYLINE_TYPE)
        .select(
            "event_slug",
            "game_date",
            market["slug"].alias("slug"),
            label("away").alias("away"),
            label("home").alias("home"),
            iso_to_utc(F.coalesce(F.nullif(market["game_start_time"], F.lit("")), F.nullif("start_date", F.lit("")))).alias("start_utc"),
        )
        .filter("away != '' AND home != ''")
    )


def _serve(asks: Column, events: Column) -> Column:
    """The (ask, event) pairs of one team pair and day: asks, in order, each take an
    unused event. The last event is taken whatever its start, else the one whose
    start is nearest within the tolerance (ties: the smaller ticker)."""
    tolerance = START_TOLERANCE_SECONDS * 1_000_000

    def step(acc: Column, ask: Column) -> Column:
        left = acc["left"]
        timed = F.filter(left, lambda e: F.abs(e["at"] - ask["at"]) <= tolerance)
        nearest = F.array_min(F.transform(timed, lambda e: F.struct(F.abs(e["at"] - ask["at"]).alias("gap"), e.alias("event"))))["event"]
        # an array of one, so that the choice is made once and then used twice
        chosen = F.array(F.when(F.size(left) == 1, F.get(left, F.lit(0))).otherwise(nearest))
        taken = F.transform(
            chosen,
            lambda c: F.when(c.isNull(), acc).otherwise(
                F.struct(
                    F.filter(left, lambda e: e["event_ticker"] != c["event_ticker"]).alias("left"),
                    F.concat(acc["pairs"], F.array(F.struct(ask.alias("ask"), c.alias("event")))).alias("pairs"),
                )
            ),
        )
        return F.get(taken, F.lit(0))

    none = F.filter(F.transform(asks, lambda a: F.struct(a.alias("ask"), F.get(events, F.lit(0)).alias("event"))), lambda p: F.lit(False))
    return F.aggregate(asks, F.struct(events.alias("left"), none.alias("pairs")), step, lambda acc: acc["pairs"])


def match_venues(a: DataFrame, b: DataFrame) -> DataFrame:
    """One-to-one pairs of the two venues' listings of one team pair and date, B
    served in slug order. A chosen event is used up; of listings that were landed
    twice the one that sorts first counts.

    Pairs with one event need no order-dependent choice and stay aggregates and a
    join. Of the others (doubleheader days) the listings of one pair and day, a
    handful, meet as arrays, and a fold serves them.
    """
    key = ["game_date", "_lo", "_hi"]
    a = keep_first(a, ["event_ticker"], [c for c in a.columns if c != "event_ticker"])
    b = keep_first(b, ["slug"], [c for c in b.columns if c != "slug"])
    at = F.when(F.col("start_utc").isNotNull(), micros("start_utc")).alias("at")
    event = F.struct("event_ticker", "away_ticker", "home_ticker", at)
    ask = F.struct("slug", "event_slug", "away", "home", at)
    left = a.select(*_low_high("away", "home"), "game_date", event.alias("event"))
    right = b.select(*_low_high("away", "home"), "game_date", ask.alias("ask"))
    counts = materialize(left.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("event").alias("event")))
    single = right.groupBy(*key).agg(F.min("ask").alias("ask")).join(counts.filter("_n = 1"), key).select("game_date", "ask", "event")
    many = counts.filter("_n > 1").select(*key)
    events = left.join(many, key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list("event")).alias("events"))
    asks = right.join(many, key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list("ask")).alias("asks"))
    served = events.join(asks, key).select("game_date", F.inline(_serve(F.col("asks"), F.col("events"))))
    return union(single, served).select(
        "game_date",
        F.col("ask.away").alias("away_team"),
        F.col("ask.home").alias("home_team"),
        F.col("event.away_ticker").alias("kalshi_ticker_away"),
        F.col("event.home_ticker").alias("kalshi_ticker_home"),
        F.col("ask.slug").alias("poly_slug"),
        F.col("event.event_ticker").alias("kalshi_event_ticker"),
        F.col("ask.event_slug").alias("poly_event_slug"),
    )


def unmatched_venues(a: DataFrame, b: DataFrame, matched: DataFrame) -> DataFrame:
    """Listings left over on either side."""
    rest_a = a.join(
        matched.select(F.col("kalshi_event_ticker").alias("event_ticker")), "event_ticker", "left_anti"
    ).select(F.lit("a").alias("venue"), F.col("event_ticker").alias("listing"), "away", "home")
    rest_b = b.join(matched.select(F.col("poly_slug").alias("slug")), "slug", "left_anti").select(
        F.lit("b").alias("venue"), F.col("slug").alias("listing"), "away", "home"
    )
    return union(rest_a, rest_b)
