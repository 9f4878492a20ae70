"""The domain's tables derived from the driver's tables, whole tables throughout.

Order → game with two markets, line items → trades and plays, customers → teams,
events → order-book snapshots and messages. Grain and key counts grow with the
data, so groups stay as small as in the domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.functions.timefn import from_micros, micros, seconds, utc_to_wall
from sparkodds.session import configure, materialize

DAY = 86400
ORIGIN = 1_704_067_200_000_000  # 2024-01-01 in microseconds
CLOCK = 20_000  # the fixture's clock runs that much faster, so books change every few seconds


class Tables:
    """Lazy reader of one scale factor's directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, df)  # read the schema once
        return df


def stored(t: Tables, name: str) -> DataFrame:
    """A fixture table of this module written once per set of tables, as a landed
    table would be."""
    key = f"_stored_{name}"
    if key not in vars(t):
        setattr(t, key, materialize(globals()[name](t)))
    return getattr(t, key)


def div(c: Column | str, n: int) -> Column:
    """Integer division."""
    return F.call_function("div", F.col(c) if isinstance(c, str) else c, F.lit(n))


# Calibration observations straight from line items


def observations(t: Tables) -> DataFrame:
    return t.lineitem.select(
        ((F.col("l_quantity") - 0.5) / 50).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when(F.col("l_linestatus") == "O", "home").otherwise("away").alias("side"),
        F.year("l_shipdate").alias("season"),
        F.col("l_shipdate").alias("sched_start"),
        "l_linenumber",
        "l_orderkey",
        "l_partkey",
    )


# Markets, trades, games, plays, weather


def ticker(order: Column, home: Column) -> Column:
    return F.concat(F.lit("KXMLBGAME-"), order.cast("string"), F.when(home, "-HOM").otherwise("-AWY"))


def trades(t: Tables) -> DataFrame:
    price = ((F.col("l_quantity") - 0.5) / 50).cast("decimal(18,6)")
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("trade_id"),
        ticker(F.col("l_orderkey"), F.col("l_linestatus") == "O").alias("ticker"),
        F.col("l_quantity").cast("decimal(18,6)").alias("count_fp"),
        price.alias("yes_price_dollars"),
        (1 - price).cast("decimal(18,6)").alias("no_price_dollars"),
        F.when(F.col("l_returnflag") == "A", "yes").otherwise("no").alias("taker_outcome_side"),
        # quarters, so that prints of one game tie
        F.date_trunc("quarter", "l_shipdate").cast("timestamp_ntz").alias("created_time"),
        "l_linenumber",
        "l_partkey",
    )


def markets(t: Tables) -> DataFrame:
    sides = F.explode(F.array(F.lit(True), F.lit(False))).alias("_home")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", sides)
    team = F.when(F.col("_home"), F.col("o_custkey") % 25).otherwise((F.col("o_custkey") + 7) % 25)
    won = (F.col("o_orderkey") % 2 == 0) == F.col("_home")
    return o.select(
        ticker(F.col("o_orderkey"), F.col("_home")).alias("ticker"),
        F.concat(F.lit("KXMLBGAME-"), F.col("o_orderkey").cast("string")).alias("event_ticker"),
        F.when(F.col("o_orderkey") % 41 == 0, "scalar").otherwise("binary").alias("market_type"),
        F.when(team == 3, "Chicago W")
        .when(F.col("o_custkey") % 97 == 5, F.when(F.col("_home"), "AL").otherwise("NL"))
        .otherwise(F.concat(F.lit("TEAM_"), team.cast("string")))
        .alias("yes_sub_title"),
        F.when(F.col("o_orderstatus") == "P", "active").otherwise("finalized").alias("status"),
        F.when(F.col("o_orderkey") % 37 == 0, "scalar").when(won, "yes").otherwise("no").alias("result"),
        F.col("o_orderdate").alias("open_time"),
        (F.col("o_orderdate") + seconds(100 * DAY)).alias("close_time"),
    )


def event_map(t: Tables) -> DataFrame:
    start = F.date_format(F.col("o_orderdate") + seconds(60 * DAY + 59700), "yyyy-MM-dd'T'HH:mm:ss")
    return t.orders.select(
        F.concat(F.lit("KXMLBGAME-"), F.col("o_orderkey").cast("string")).alias("event_ticker"),
        F.col("o_orderkey").alias("game_pk"),
        F.lit("HOM").alias("home_abbr"),
        F.lit("AWY").alias("away_abbr"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(start, F.lit("+00:00"))).alias("ticker_start_utc"),
    )


def games(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("game_pk"), (F.col("o_orderdate") + seconds(61 * DAY)).alias("game_date")
    )


def weather(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    condition = (
        F.when(p == "1-URGENT", "Clear").when(p == "2-HIGH", "Cloudy").when(p == "3-MEDIUM", "Roof Closed")
        .when(p == "4-NOT SPECIFIED", "Rain").otherwise("Snow")
    )
    mph = F.concat((F.col("o_custkey") % 20).cast("string"), F.lit(" mph, Out To CF"))
    return t.orders.filter(F.col("o_orderkey") % 3 != 0).select(
        F.col("o_orderkey").alias("game_pk"),
        condition.alias("condition"),
        (F.col("o_custkey") % 40 + 50).cast("string").alias("temp"),
        F.when(F.col("o_custkey") % 11 == 0, "Calm").otherwise(mph).alias("wind"),
    )


#: Line items that a task groups at most, about.
GAME_ROWS = 150_000


def by_game(t: Tables, *columns: str) -> DataFrame:
    """Line items with an order's in one partition, in as many partitions as there
    are GAME_ROWS of them (footers tell), so that a task's memory doesn't grow with
    the table. What is then grouped, joined or ordered by game stays in place."""
    if "_line_items" not in vars(t):
        t._line_items = t.lineitem.count()
    return t.lineitem.select("l_orderkey", *columns).repartition(t._line_items // GAME_ROWS + 1, "l_orderkey")


def plays(t: Tables) -> DataFrame:
    return by_game(t, "l_linenumber", "l_shipdate").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("start_time")).select(
        F.col("l_orderkey").alias("game_pk"),
        F.col("l_linenumber").alias("at_bat_index"),
        F.col("l_linenumber").alias("inning"),
        "start_time",
    )


def win_probability(t: Tables) -> DataFrame:
    return by_game(t, "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_quantity") * 2).alias("home_wp")).select(
        F.col("l_orderkey").alias("game_pk"),
        F.col("l_linenumber").alias("at_bat_index"),
        "home_wp",
        (100 - F.col("home_wp")).alias("away_wp"),
    )


# prints are quarters apart, so windows are about two years here
WINDOW_HOURS = 700 * 24
BIN_HOURS = 200 * 24


# Order books


def fast_clock(ts: str = "ts") -> Column:
    since = micros(ts) - ORIGIN
    return from_micros(F.lit(ORIGIN) + div(since, CLOCK))


def matched_markets(t: Tables) -> DataFrame:
    u = F.col("user_id").cast("string")
    return t.events.select("user_id").distinct().select(
        F.col("user_id").alias("id"),
        F.lit("2024-01-01").cast("date").alias("game_date"),
        F.concat(F.lit("A"), u).alias("away_team"),
        F.concat(F.lit("H"), u).alias("home_team"),
        F.concat(F.lit("KA"), u).alias("kalshi_ticker_away"),
        F.concat(F.lit("KH"), u).alias("kalshi_ticker_home"),
        F.concat(F.lit("P"), u).alias("poly_slug"),
        F.concat(F.lit("E"), u).alias("kalshi_event_ticker"),
        F.concat(F.lit("PE"), u).alias("poly_event_slug"),
    )


def orderbook_snapshots(t: Tables) -> DataFrame:
    """Views and clicks are one venue's YES and NO books, signups and errors the
    other's bids and offers; every 13th book is empty, every 4th source time is
    cut to the second (ties), every 101st is missing."""
    kind = F.col("event_type")
    venue_a = kind.isin("view", "click")
    u = F.col("user_id").cast("string")
    base = F.when(kind == "error", 40).when(kind == "click", 31).otherwise(30)
    cents = base + F.floor("value").cast("int") % 30
    price = F.concat(F.lit("0."), cents.cast("string"))
    worse = F.concat(F.lit("0."), (cents - F.when(venue_a | (kind == "signup"), 5).otherwise(-5)).cast("string"))
    size = F.concat((F.col("event_id") % 500).cast("string"), F.lit(".50"))
    best_level = F.concat(F.lit('["'), price, F.lit('", "'), size, F.lit('"]'))
    worse_level = F.concat(F.lit('["'), worse, F.lit('", "77.00"]'))
    book = F.when(F.col("event_id") % 13 == 0, F.lit("[]")).when(
        venue_a, F.concat(F.lit("["), worse_level, F.lit(", "), best_level, F.lit("]"))
    ).otherwise(F.concat(F.lit("["), best_level, F.lit(", "), worse_level, F.lit("]")))
    source = F.when(F.col("event_id") % 4 == 0, F.date_trunc("second", "_at").cast("timestamp_ntz")).otherwise(F.col("_at"))
    ms = micros("_src")
    return (
        t.events.filter(kind != "purchase")
        .withColumn("_at", fast_clock())
        .withColumn("_src", source)
        .select(
            F.col("event_id").alias("id"),
            utc_to_wall(F.col("_at") + seconds(0.05)).alias("timestamp"),
            F.when(venue_a, "kalshi").otherwise("polymarket").alias("platform"),
            F.concat(F.when(venue_a, "KA").otherwise("P"), u).alias("market_id"),
            F.when(kind == "view", "yes").when(kind == "click", "no").when(kind == "signup", "bids")
            .otherwise("offers").alias("side"),
            book.alias("book_json"),
            F.when(
                F.col("event_id") % 101 != 0,
                F.when(venue_a, div(ms, 1000).cast("string")).otherwise(
                    F.concat(F.date_format("_src", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
                ),
            ).alias("source_timestamp"),
        )
    )


def collection_metadata(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("start", "reconnect", "error", "stop")])
    return (
        t.events.filter((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0))
        .select(
            F.col("event_id").alias("id"),
            F.get(kinds, (div("event_id", 5) % 4).cast("int")).alias("event"),
            F.lit("kalshi").alias("platform"),
            utc_to_wall(fast_clock()).alias("timestamp"),
        )
    )


BLACKOUT_SECONDS = 0.2
SLICE_SECONDS = 20.0


def book_messages(t: Tables) -> DataFrame:
    """Every purchase is a snapshot of both sides, every other event a signed
    delta on one of ten levels of a side."""
    kind = F.col("event_type")
    k = F.col("event_id")
    yes = F.concat(F.lit('[["0.4100","'), (k % 90 + 1).cast("string"), F.lit('.00"],["0.4300","5.50"]]'))
    no = F.concat(F.lit('[["0.5100","'), (k % 70 + 1).cast("string"), F.lit('.25"]]'))
    at = F.floor(micros(fast_clock()) / F.lit(1000.0)).cast("string")
    who = F.concat(F.lit("T"), F.col("user_id").cast("string"))
    snapshot = F.concat(
        F.lit('{"type":"orderbook_snapshot","msg":{"market_ticker":"'), who, F.lit('","ts_ms":'), at,
        F.lit(',"yes_dollars_fp":'), yes, F.lit(',"no_dollars_fp":'), no, F.lit("}}"),
    )
    side = F.when(kind.isin("view", "click"), "yes").otherwise("no")
    price = F.concat(F.when(side == "yes", "0.4").otherwise("0.5"), (F.floor("value").cast("int") % 10).cast("string"), F.lit("00"))
    qty = F.concat((F.floor("value").cast("int") % 61 - 25).cast("string"), F.lit(".00"))
    delta = F.concat(
        F.lit('{"type":"orderbook_delta","msg":{"market_ticker":"'), who, F.lit('","ts_ms":'), at,
        F.lit(',"side":"'), side, F.lit('","price_dollars":"'), price, F.lit('","delta_fp":"'), qty, F.lit('"}}'),
    )
    return t.events.select("event_id", "event_type", "user_id", "value", "ts").select(
        k.alias("seq"), F.when(kind == "purchase", snapshot).otherwise(delta).alias("payload")
    )


# Entity resolution


def letters(n: Column, size: int = 5) -> Column:
    return F.concat(*[F.char((65 + div(n, 26**i) % 26).cast("int")) for i in reversed(range(size))])


def _duels(t: Tables) -> DataFrame:
    """One row per order: first day of its quarter (twenty years on, tickers are
    of this century), away and home team, hour of the start."""
    away = div("o_custkey", 3)
    return t.orders.select(
        F.col("o_orderkey").alias("k"),
        F.add_months(F.trunc("o_orderdate", "quarter"), 240).cast("timestamp_ntz").alias("day"),
        away.alias("away"),
        (away + 1 + F.col("o_orderkey") % 3).alias("home"),
        (F.col("o_orderkey") % 24).alias("hour"),
        "o_orderstatus",
    )


def teams(t: Tables) -> DataFrame:
    team = div("c_custkey", 3)
    return t.customer.select(team.alias("id")).distinct().select(
        letters(F.col("id")).alias("abbr"), F.col("id").cast("int").alias("team_id")
    )


def duel_games(t: Tables) -> DataFrame:
    """Schedule as in ``matching.load_games``; some orders have no game, some
    games are listed a day later, swapped, or without an end."""
    k = F.col("k")
    hours = F.col("hour") + 5 + k % 9 - 4
    start = F.timestamp_add("HOUR", hours, F.col("day"))
    swap = k % 50 == 0
    return _duels(t).filter(~((F.col("o_orderstatus") == "P") & (k % 4 == 0))).select(
        k.alias("game_pk"),
        start.alias("game_date"),
        F.date_add(F.col("day").cast("date"), F.when(k % 17 == 0, 1).otherwise(0)).alias("official_date"),
        F.when(swap, F.col("home")).otherwise(F.col("away")).cast("int").alias("away_team_id"),
        F.when(swap, F.col("away")).otherwise(F.col("home")).cast("int").alias("home_team_id"),
        (1 + k % 2).cast("int").alias("game_number"),
        F.when(k % 11 != 0, start + seconds(3 * 3600)).alias("actual_end"),
        (k % 2 == 0).alias("away_is_winner"),
        (k % 2 == 1).alias("home_is_winner"),
    )


def duel_event_ticker() -> Column:
    k = F.col("k")
    month = F.when(k % 101 == 0, "XXX").otherwise(F.upper(F.date_format("day", "MMM")))
    clock = F.when(k % 3 != 0, F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit("05"))).otherwise("")
    number = F.when(k % 6 == 0, F.concat(F.lit("G"), (1 + k % 2).cast("string"))).otherwise("")
    return F.concat(
        F.lit("KXMLBGAME-"), F.date_format("day", "yy"), month, F.date_format("day", "dd"), clock,
        letters(F.col("away")), letters(F.col("home")), number,
    )


def _listed(t: Tables) -> DataFrame:
    # a ticker names an event once, however many orders spell it
    spelled = _duels(t).filter(F.col("k") % 9 != 0).withColumn("event_ticker", duel_event_ticker())
    return spelled.groupBy("event_ticker").agg(
        F.min("k").alias("k"), F.min("day").alias("day"), F.min("away").alias("away"),
        F.min_by("home", "k").alias("home"), F.min_by("hour", "k").alias("hour"),
    )


def duel_events(t: Tables) -> DataFrame:
    return _listed(t).select("event_ticker", F.lit("KXMLBGAME").alias("series_ticker"))


def duel_markets(t: Tables) -> DataFrame:
    """Two markets per event, named by team; some settle a month late, some as
    scalar, some carry a suffix that does not fit the ticker."""
    k = F.col("k")
    days = F.when(k % 13 == 0, 30).when(k % 7 == 0, 1).otherwise(0)
    hours = F.col("hour") + 9 + k % 9 - 4 + days * 24
    close = F.concat(F.date_format(F.timestamp_add("HOUR", hours, F.col("day")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    home = F.when(k % 103 == 0, F.lit("QQQQQ")).otherwise(letters(F.col("home")))
    sides = F.array(
        F.struct(letters(F.col("away")).alias("suffix"), F.lit(True).alias("is_away")),
        F.struct(home.alias("suffix"), F.lit(False).alias("is_away")),
    )
    won = (k % 2 == 0) == F.col("is_away")
    return _listed(t).select("event_ticker", "k", close.alias("close_time"), F.inline(sides)).select(
        F.concat_ws("-", "event_ticker", "suffix").alias("ticker"),
        "event_ticker",
        F.when(k % 19 == 0, "active").otherwise("finalized").alias("status"),
        F.when(k % 29 == 0, "scalar").when(won, "yes").otherwise("no").alias("result"),
        "close_time",
    )


# Landed text and payloads


def iso(ts: Column | str) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def raw_trades(t: Tables) -> DataFrame:
    """Trades as text; every 97th part has an unreadable price."""
    price = ((F.col("l_quantity") - 0.5) / 50).cast("decimal(18,2)").cast("string")
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
        F.col("l_orderkey").cast("string").alias("ticker"),
        F.col("l_quantity").cast("int").cast("string").alias("count_fp"),
        F.when(F.col("l_partkey") % 97 == 0, "n/a").otherwise(price).alias("yes_price_dollars"),
        iso("l_shipdate").alias("created_time"),
    )


def raw_markets(t: Tables) -> DataFrame:
    """One market per order; some without open or close time."""
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("ticker"),
        F.when(F.col("o_orderstatus") == "F", "finalized").otherwise("active").alias("status"),
        F.when(F.col("o_orderkey") % 7 != 0, iso("o_orderdate")).alias("open_time"),
        F.when(F.col("o_orderkey") % 5 != 0, iso(F.col("o_orderdate") + seconds(400 * DAY))).alias("close_time"),
    )


def schedule_payloads(t: Tables) -> DataFrame:
    """One schedule response per order, listing its game on one or two dates."""
    k = F.col("o_orderkey")

    def team(number: Column, name: str) -> Column:
        return F.struct(
            F.struct(number.cast("int").alias("id"), F.concat(F.lit(name), number.cast("string")).alias("name")).alias("team"),
            F.when(F.col("o_orderstatus") != "P", (k % 9).cast("int")).alias("score"),
            F.when(F.col("o_orderstatus") != "P", k % 2 == 0).alias("isWinner"),
        )

    def listing(state: str) -> Column:
        return F.struct(
            k.alias("gamePk"),
            F.when(k % 10 == 0, "S").otherwise("R").alias("gameType"),
            iso("o_orderdate").alias("gameDate"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("officialDate"),
            F.struct(F.lit("F").alias("codedGameState"), F.lit(state).alias("detailedState")).alias("status"),
            F.struct(team(F.col("o_custkey"), "A").alias("away"), team(F.col("o_custkey") + 1, "H").alias("home")).alias("teams"),
            F.struct((k % 30).cast("int").alias("id"), F.lit("park").alias("name")).alias("venue"),
            F.lit("N").alias("doubleHeader"),
            F.lit(1).alias("gameNumber"),
            F.when(k % 2 == 0, "day").alias("dayNight"),
        )

    def day(state: str) -> Column:
        return F.struct(F.lit("2024-01-01").alias("date"), F.array(listing(state)).alias("games"))

    dates = F.when(k % 4 == 0, F.array(day("Postponed"), day("Final"))).otherwise(F.array(day("Final")))
    return t.orders.select(k.alias("page"), F.to_json(F.struct(dates.alias("dates"))).alias("payload"))


def game_payloads(t: Tables) -> DataFrame:
    """Play-by-play, win probability and live payload of every line item's game."""
    n = F.col("l_linenumber")
    play = F.struct(
        F.struct(
            n.alias("atBatIndex"), F.lit("top").alias("halfInning"), n.alias("inning"),
            iso("l_shipdate").alias("startTime"), F.when(n % 2 == 0, iso("l_shipdate")).alias("endTime"),
            (F.col("l_returnflag") == "R").alias("isScoringPlay"),
        ).alias("about"),
        F.struct(F.col("l_returnflag").alias("event"), n.alias("awayScore"), F.lit(0).alias("homeScore")).alias("result"),
    )
    wp = F.struct(
        n.alias("atBatIndex"), F.col("l_quantity").alias("homeTeamWinProbability"),
        (100 - F.col("l_quantity")).alias("awayTeamWinProbability"), iso("l_shipdate").alias("playEndTime"),
    )
    weather_text = F.struct(
        F.col("l_returnflag").alias("condition"), F.col("l_quantity").cast("int").cast("string").alias("temp"),
        F.concat(n.cast("string"), F.lit(" mph, In")).alias("wind"),
    )
    live = F.struct(F.struct(F.when(n != 3, weather_text).alias("weather")).alias("gameData"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("game_pk"),
        F.col("l_partkey").alias("part"),
        F.to_json(F.struct(F.array(play, play).alias("allPlays"))).alias("plays"),
        F.to_json(F.array(wp)).alias("win_probability"),
        F.to_json(live).alias("live"),
    )


def event_payloads(t: Tables) -> DataFrame:
    """One page of two items per order; broken JSON, a wrong type or a missing
    field here and there."""
    k = F.col("o_orderkey")
    item = F.struct(
        F.concat(F.lit("E"), k.cast("string")).alias("event_ticker"), F.lit("S").alias("series_ticker"),
        F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("category"),
    )
    page = F.to_json(F.struct(F.array(item, item).alias("events"), F.lit("next").alias("cursor")))
    return t.orders.select(k.alias("page"), F.when(k % 23 == 0, F.substring(page, 1, 40)).otherwise(page).alias("payload"))


def record_payloads(t: Tables) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    whole = F.concat(F.lit('{"id":'), k, F.lit(',"name":"'), F.col("c_name"), F.lit('","balance":'), F.col("c_acctbal").cast("string"), F.lit("}"))
    return t.customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit('{"id":'), k))
        .when(F.col("c_custkey") % 13 == 0, F.concat(F.lit('{"id":'), k, F.lit("}")))
        .when(F.col("c_custkey") % 17 == 0, F.concat(F.lit('{"id":"x'), k, F.lit('","name":"n"}')))
        .otherwise(whole).alias("payload"),
    )


def league_payloads(t: Tables) -> DataFrame:
    """Nested league events: one per order, a moneyline and another market each."""
    d = _duels(t)
    k = F.col("k")

    def side(team: Column, ordering: str) -> Column:
        return F.struct(
            F.concat(k.cast("string"), F.lit(ordering)).alias("id"),
            F.struct(
                team.cast("int").alias("id"), letters(team).alias("name"), F.lower(letters(team)).alias("abbreviation"),
                F.when((k % 31 == 0) & (F.lit(ordering) == "home"), "nba").otherwise("mlb").alias("league"),
                F.when(k % 2 == 0, letters(team)).alias("displayAbbreviation"), F.lit(ordering).alias("ordering"),
            ).alias("team"),
        )

    start = iso(F.timestamp_add("HOUR", F.col("hour") + 4, F.col("day")))

    def market(kind: str) -> Column:
        return F.struct(
            k.cast("string").alias("id"), F.concat(F.lit(f"{kind[:1]}-"), F.lpad(k.cast("string"), 9, "0")).alias("slug"),
            F.lit(kind).alias("sportsMarketType"),
            F.array(side(F.col("away"), "away"), side(F.col("home"), "home")).alias("marketSides"),
            F.when(k % 3 != 0, start).alias("gameStartTime"),
        )

    slug = F.concat(F.lit("mlb-"), k.cast("string"), F.lit("-"), F.date_format("day", "yyyy-MM-dd"))
    event = F.struct(
        k.cast("string").alias("id"), slug.alias("slug"), F.lit("t").alias("title"),
        F.when(k % 6 == 0, start).alias("startDate"),
        F.array(market("baseball_team_full_game_winner"), market("spread")).alias("markets"),
    )
    return d.filter(k % 5 != 0).select(k, F.to_json(F.struct(F.array(event).alias("events"))).alias("payload"))
