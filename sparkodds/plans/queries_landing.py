"""Named queries for landing, planning, data quality and cross-venue matching."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkodds import schemas
from sparkodds.functions import timefn as tf
from sparkodds.functions.tickers import TEAM_IDS, date_prefix, pair_key, slug_date, team_dimension
from sparkodds.operators import connections, latest, matching, planning, quality, snapshots
from sparkodds.operators.unions import union
from sparkodds.plans import calibration as calibration_plan
from sparkodds.plans import collection
from sparkodds.plans import fixtures as fx
from sparkodds.plans import oracles as o
from sparkodds.plans.queries import AGREE, _arb, _context, _duel_inputs, _innings, _pre, _window, query
from sparkodds.session import materialize, new_path
from sparkodds.sources import landing, sinks, typed

ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def iso_sql(c: str) -> str:
    return ISO.format(c=c)


RAW_TRADES = f"""raw_trades AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trade_id,
    l_orderkey::VARCHAR AS ticker, l_quantity::INT::VARCHAR AS count_fp,
    CASE WHEN l_partkey % 97 = 0 THEN 'n/a' ELSE ((l_quantity - 0.5) / 50)::DECIMAL(18,2)::VARCHAR END AS yes_price_dollars,
    {iso_sql('l_shipdate')} AS created_time, l_shipdate AS shipped FROM lineitem)"""
RAW_MARKETS = """raw_markets AS (SELECT o_orderkey::VARCHAR AS ticker, if(o_orderstatus = 'F', 'finalized', 'active') AS status,
    if(o_orderkey % 7 <> 0, o_orderdate, NULL) AS open_at, if(o_orderkey % 5 <> 0, o_orderdate + INTERVAL 400 DAY, NULL) AS close_at FROM orders)"""


# Typed views


@query(
    "typed_view_casts",
    o.with_(RAW_TRADES, final="""SELECT trade_id, ticker, CAST(count_fp AS DECIMAL(18,6)) AS count_fp,
        CAST(yes_price_dollars AS DECIMAL(18,6)) AS yes_price_dollars, shipped AS created_time FROM raw_trades WHERE yes_price_dollars <> 'n/a'"""),
)
def typed_view_casts(t):
    readable = fx.raw_trades(t).filter("yes_price_dollars <> 'n/a'")
    return typed.cast_columns(readable, times=("created_time",), decimals=("count_fp", "yes_price_dollars"))


@query(
    "castability",
    o.with_(RAW_TRADES, final="""SELECT c AS "check", n_bad FROM (SELECT unnest(['created_time', 'count_fp', 'yes_price_dollars']) AS c,
        unnest([0, 0, (SELECT count(*) FROM raw_trades WHERE yes_price_dollars = 'n/a')]) AS n_bad)"""),
)
def castability(t):
    return quality.castability(
        fx.raw_trades(t),
        {"created_time": "timestamp", "count_fp": typed.DECIMAL, "yes_price_dollars": typed.DECIMAL},
    )


# Payloads

GAME_LISTS = f"""listings AS (SELECT o_orderkey AS game_pk, if(o_orderkey % 10 = 0, 'S', 'R') AS game_type, {iso_sql('o_orderdate')} AS game_date,
    strftime(o_orderdate, '%Y-%m-%d') AS official_date, 'F' AS coded_game_state, s.state AS detailed_state,
    o_custkey::INT AS away_team_id, 'A' || o_custkey AS away_team_name, if(o_orderstatus <> 'P', o_orderkey % 9, NULL)::INT AS away_score,
    if(o_orderstatus <> 'P', o_orderkey % 2 = 0, NULL) AS away_is_winner,
    (o_custkey + 1)::INT AS home_team_id, 'H' || (o_custkey + 1) AS home_team_name, if(o_orderstatus <> 'P', o_orderkey % 9, NULL)::INT AS home_score,
    if(o_orderstatus <> 'P', o_orderkey % 2 = 0, NULL) AS home_is_winner,
    (o_orderkey % 30)::INT AS venue_id, 'park' AS venue_name, 'N' AS double_header, 1 AS game_number,
    if(o_orderkey % 2 = 0, 'day', NULL) AS day_night FROM orders, (VALUES ('Final'), ('Postponed')) s(state)
    WHERE s.state = 'Final' OR o_orderkey % 4 = 0)"""


def _schedule(t):
    return landing.schedule_games(landing.parse(fx.schedule_payloads(t), "payload", schemas.SCHEDULE))


@query("schedule_flatten", o.with_(GAME_LISTS, final="SELECT * FROM listings"))
def schedule_flatten(t):
    return _schedule(t)


@query("schedule_last_listing", o.with_(GAME_LISTS, final="SELECT * FROM listings WHERE detailed_state = 'Final' AND game_type = 'R'"))
def schedule_last_listing(t):
    rank = F.when(F.col("detailed_state") == "Final", 1).otherwise(0)
    return planning.schedule_games(_schedule(t), rank)


@query(
    "plays_flatten",
    f"""SELECT l_orderkey AS game_pk, l_linenumber AS at_bat_index, l_linenumber AS inning, 'top' AS half_inning, {iso_sql('l_shipdate')} AS start_time,
        if(l_linenumber % 2 = 0, {iso_sql('l_shipdate')}, NULL) AS end_time, l_returnflag AS event, l_linenumber AS away_score, 0 AS home_score,
        l_returnflag = 'R' AS is_scoring_play FROM lineitem, (VALUES (1), (2))""",
)
def plays_flatten(t):
    return landing.plays(landing.parse(fx.game_payloads(t), "plays", schemas.PLAY_BY_PLAY, ["game_pk"]))


@query(
    "win_probability_flatten",
    f"""SELECT l_orderkey AS game_pk, l_linenumber AS at_bat_index, l_quantity AS home_wp, 100 - l_quantity AS away_wp,
        NULL::DOUBLE AS home_wp_added, {iso_sql('l_shipdate')} AS play_end_time FROM lineitem""",
)
def win_probability_flatten(t):
    return landing.win_probability(fx.game_payloads(t), "win_probability")


@query(
    "weather_optional",
    """SELECT l_orderkey AS game_pk, l_returnflag AS condition, l_quantity::INT::VARCHAR AS temp, l_linenumber || ' mph, In' AS wind
       FROM lineitem WHERE l_linenumber <> 3""",
)
def weather_optional(t):
    return landing.weather(landing.parse(fx.game_payloads(t), "live", schemas.LIVE_FEED, ["game_pk"]))


@query(
    "page_items",
    """SELECT 'E' || o_orderkey AS event_ticker, 'S' AS series_ticker, o_orderstatus AS title, o_orderpriority AS category, NULL AS sub_title
       FROM orders, (VALUES (1), (2)) WHERE o_orderkey % 23 <> 0""",
)
def page_items(t):
    pages = landing.parse(fx.event_payloads(t), "payload", schemas.EVENT_PAGE)
    good, _ = landing.split_valid(pages, ["events"])
    return landing.page_items(good, "events")


_REASON = """CASE WHEN c_custkey % 11 = 0 THEN 'malformed' WHEN c_custkey % 13 = 0 THEN 'missing name'
    WHEN c_custkey % 17 = 0 THEN 'malformed' END"""


@query("quarantine", f"SELECT coalesce({_REASON}, 'valid') AS reason, count(*) AS n FROM customer GROUP BY 1")
def quarantine(t):
    records = landing.parse(fx.record_payloads(t), "payload", "id bigint, name string, balance double")
    good, bad = landing.split_valid(records, ["id", "name"])
    labelled = union(bad.select("reason"), good.select(F.lit("valid").alias("reason")))
    return labelled.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_G = "dates[].games[]"


@query(
    "payload_faults",
    f"""WITH f AS (SELECT o_custkey, unnest([
        CASE WHEN o_orderkey % 5 = 0 THEN '{_G}.gamePk' END, CASE WHEN o_orderkey % 7 = 0 THEN '{_G}.status' END,
        CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 4 = 0 THEN '{_G}.status.detailedState' END,
        CASE WHEN o_orderkey % 11 = 0 THEN '{_G}.teams.home.team.name' END, CASE WHEN o_orderkey % 13 = 0 THEN '{_G}.doubleHeader' END]) AS path
        FROM orders WHERE o_custkey % 10 <> 3)
    SELECT path, 'missing' AS reason, count(*) AS n, count(DISTINCT o_custkey) AS payloads FROM f WHERE path IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'dates[].date', 'missing', count(*), count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 10 <> 3 AND o_custkey % 6 = 0) HAVING count(*) > 0
    UNION ALL SELECT '$', 'malformed', count(*), count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 10 = 3) HAVING count(*) > 0""",
)
def payload_faults(t):
    """Planted faults by path: a customer's orders as the games of a schedule page."""
    key = F.col("o_orderkey")
    unless = lambda n, c: F.when(key % n != 0, c)
    team = lambda name: F.struct(F.struct(F.lit(1).alias("id"), name.alias("name")).alias("team"))
    game = F.struct(
        unless(5, key).alias("gamePk"), F.lit("R").alias("gameType"), F.lit("2026-04-30T16:35:00Z").alias("gameDate"), F.lit("2026-04-30").alias("officialDate"),
        unless(7, F.struct(F.lit("F").alias("codedGameState"), unless(4, F.lit("Final")).alias("detailedState"))).alias("status"),
        F.struct(team(F.lit("A")).alias("away"), team(unless(11, F.lit("H"))).alias("home")).alias("teams"),
        F.struct(F.lit(1).alias("id")).alias("venue"), unless(13, F.lit("N")).alias("doubleHeader"), F.lit(1).alias("gameNumber"),
    )
    pages = t.orders.groupBy("o_custkey").agg(F.collect_list(game).alias("games"))  # a customer has a few dozen orders
    dated = F.struct(F.when(F.col("o_custkey") % 6 != 0, "2026-04-30").alias("date"), "games")
    text = F.to_json(F.struct(F.array(dated).alias("dates")))
    payload = F.when(F.col("o_custkey") % 10 == 3, F.expr("left(text, length(text) - 4)")).otherwise(F.col("text")).alias("payload")
    landed = materialize(pages.select("o_custkey", text.alias("text")).select("o_custkey", payload))
    found = landing.faults(landing.parse(landed, "payload", schemas.SCHEDULE, ["o_custkey"]), "schedule", ["o_custkey"])
    return found.groupBy("path", "reason").agg(F.sum("n").alias("n"), F.countDistinct("o_custkey").alias("payloads"))


# Latest row, upsert


@query(
    "dedupe_keep_last",
    """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice,
        arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS o_orderdate FROM orders GROUP BY o_custkey""",
)
def dedupe_keep_last(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return latest.keep_last(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "upsert_merge",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'live' ELSE 'historical' END AS tier,
        CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""",
)
def upsert_merge(t):
    historical = t.orders.filter("o_orderkey % 2 = 0").select(
        "o_orderkey", F.lit("historical").alias("tier"), F.col("o_totalprice").alias("price")
    )
    live = t.orders.filter("o_orderkey % 3 = 0").select(
        (F.col("o_totalprice") * 2).alias("price"), "o_orderkey", F.lit("live").alias("tier")
    )
    return latest.upsert(historical, live, ["o_orderkey"])


@query(
    "stored_added_column",
    """SELECT o_orderkey AS id, year(o_orderdate)::INT AS season, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS status,
        CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority FROM orders""",
)
def stored_added_column(t):
    """Three days' upserts into one partitioned table: the second brings a column,
    the third lacks it again."""
    path = new_path(t.spark)
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    third = rows.filter("id % 3 = 0").select("status", "season", "id").withColumn("status", F.lit("F"))
    for day in (rows.drop("priority"), rows.filter("id % 2 = 0"), third):
        sinks.upsert_table(day, path, ["id"], ["season"], check_moves=False)
    return sinks.table(t.spark, path)


@query(
    "stored_versions",
    """SELECT o_orderstatus, count(*) AS n, 1 AS version FROM orders GROUP BY 1 UNION ALL
       SELECT o_orderstatus, count(*), 2 FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1""",
)
def stored_versions(t):
    """A reader of the first version, beside one of the version that replaced it."""
    path, by = new_path(t.spark), ["o_orderstatus"]
    first = sinks.rebuild(t.orders, path)
    sinks.rebuild(t.orders.filter("o_orderdate >= '1995-01-01'"), path)
    each = [(first, 1), (sinks.table(t.spark, path), 2)]
    return union(*(df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("version", F.lit(v)) for df, v in each))


@query(
    "stored_appends",
    """SELECT n_nationkey AS nation, count(*) AS n, count(*) AS n_ids, true AS ascending FROM customer JOIN nation ON c_nationkey = n_nationkey
       WHERE n_nationkey < 4 GROUP BY 1""",
)
def stored_appends(t):
    """Four appends with ingestion time and ids; whether later ones have greater ids."""
    path = new_path(t.spark)
    for nation in range(4):
        sinks.append(t.customer.filter(F.col("c_nationkey") == nation).select("c_custkey", F.col("c_nationkey").alias("nation")), path)
    found = sinks.table(t.spark, path).groupBy("nation").agg(
        F.count("timestamp").alias("n"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("low"), F.max("id").alias("high")
    )
    before = F.lag("high").over(Window.orderBy("nation"))  # four rows
    return found.select("nation", "n", "n_ids", F.coalesce(F.col("low") > before, F.lit(True)).alias("ascending"))


@query(
    "pull_run_states",
    """WITH phases AS (SELECT o_orderkey, o_orderstatus, unnest(['historical', 'live']) AS phase, o_orderdate FROM orders),
    planned AS (SELECT * FROM phases WHERE phase = 'live' OR o_orderdate < TIMESTAMP '1996-01-01'),
    sent AS (SELECT l_orderkey, CASE WHEN l_linenumber > 3 THEN 'live' ELSE 'historical' END AS phase,
        CASE WHEN l_linenumber > 3 THEN l_linenumber - 3 ELSE l_linenumber END AS page,
        l_linenumber = 3 OR l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_last, l_partkey FROM lineitem),
    kept AS (SELECT l_orderkey, phase, list_distinct(list(page)) AS pages, list_distinct(list(page) FILTER (is_last)) AS ends
             FROM sent WHERE l_partkey % 9 <> 0 GROUP BY 1, 2),
    told AS (SELECT p.*, CASE WHEN pages IS NULL THEN 'planned' WHEN len(ends) > 0 AND len(list_intersect(pages, range(1, list_max(ends) + 1))) = list_max(ends)
        THEN 'complete' ELSE 'landed' END AS state FROM planned p LEFT JOIN kept k ON k.l_orderkey = p.o_orderkey AND k.phase = p.phase),
    marks AS (SELECT o_orderkey, o_orderstatus = 'F' AND bool_and(state = 'complete') AS marked FROM told GROUP BY o_orderkey, o_orderstatus)
    SELECT phase, state, count(*) AS n, count(*) FILTER (marked) AS n_marked FROM told JOIN marks USING (o_orderkey) GROUP BY 1, 2""",
)
def pull_run_states(t):
    """Parts of a run by state, and how many belong to markets that the run marks:
    orders as markets, line items as pages, every ninth lost."""
    market = F.col("o_orderkey").cast("string").alias("ticker")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    plan = t.orders.select(market, F.lit(None).cast("bigint").alias("min_ts"), early.alias("historical"), F.lit(True).alias("live"))
    markets = t.orders.select(market, F.when(F.col("o_orderstatus") == "F", "finalized").otherwise("active").alias("status"))
    late = F.col("l_linenumber") > 3
    lines = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("_end"))
    pages = t.lineitem.filter("l_partkey % 9 <> 0").join(lines, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("ticker"),
        F.when(late, "live").otherwise("historical").alias("phase"),
        F.when(late, F.col("l_linenumber") - 3).otherwise(F.col("l_linenumber")).alias("page"),
        ((F.col("l_linenumber") == 3) | (F.col("l_linenumber") == F.col("_end"))).alias("is_last"),
    )
    states = materialize(planning.run_states(planning.run_phases(plan), pages))
    marked = planning.completed_in_run(states, markets).withColumn("marked", F.lit(True))
    return states.join(marked, "ticker", "left").groupBy("phase", "state").agg(F.count("*").alias("n"), F.count("marked").alias("n_marked"))


@query(
    "typed_views",
    o.with_(GAME_LISTS, final="""SELECT year(game_date::TIMESTAMP)::INT AS season, count(*) AS n, max(official_date::DATE) AS last_day,
        max(epoch_us(game_date::TIMESTAMP)) AS last_start FROM listings GROUP BY 1"""),
)
def typed_views(t):
    """A SQL text over the typed view of landed games."""
    typed.register_views({"mlb_games": _schedule(t)})
    return t.spark.sql("""SELECT year(game_date) AS season, count(*) AS n, max(official_date) AS last_day,
        max(unix_micros(cast(game_date AS timestamp))) AS last_start FROM mlb_games_typed GROUP BY 1""")


@query(
    "exported_csv",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def exported_csv(t):
    """Orders as people get them, read again."""
    path = new_path(t.spark)
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    sinks.export_csv(rows, path)
    return t.spark.read.schema(rows.schema).option("header", True).csv(path)


@query(
    "required_tables",
    """SELECT 'orders' AS name, true AS present, (SELECT count(*) FROM orders) AS n_rows UNION ALL
       SELECT 'lineitem', true, (SELECT count(*) FROM lineitem) UNION ALL SELECT 'never_landed', false, NULL""",
)
def required_tables(t):
    """Which of the required tables and views there are, and their rows."""
    names = ["orders", "lineitem", "never_landed"]
    typed.register_views({n: getattr(t, n) for n in names[:2]})
    missing = quality.tables_missing(t.spark, names)
    return union(*[
        t.spark.range(1).select(F.lit(n).alias("name"), F.lit(False).alias("present"), F.lit(None).cast("bigint").alias("n_rows"))
        if n in missing
        else t.spark.table(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), F.lit(True).alias("present"), "n_rows")
        for n in names
    ])


@query(
    "games_with_ends",
    o.with_(GAME_LISTS, final="""SELECT game_pk, game_date::TIMESTAMP AS game_date, official_date::DATE AS official_date, away_team_id, home_team_id,
        game_number, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = game_pk AND l_linenumber > 1) AS actual_end FROM listings"""),
)
def games_with_ends(t):
    """Schedule rows with the end of their last play, where there is one."""
    plays = t.lineitem.filter("l_linenumber > 1").select(F.col("l_orderkey").alias("game_pk"), fx.iso("l_shipdate").alias("end_time"))
    return matching.load_games(_schedule(t), plays)


@query(
    "team_ids",
    f"""WITH teams(abbr, team_id) AS (VALUES {', '.join(str(pair) for pair in TEAM_IDS.items())}),
    ranked AS (SELECT *, row_number() OVER (ORDER BY abbr) - 1 AS n FROM teams)
    SELECT team_id, count(*) AS n_customers, count(DISTINCT abbr) AS n_names, min(abbr) AS first_name
    FROM customer LEFT JOIN ranked ON n = c_custkey % 33 GROUP BY team_id""",
)
def team_ids(t):
    """Customers by the team their label names: two labels of one team are one,
    unknown labels have none."""
    labels = F.array(*[F.lit(a) for a in sorted(TEAM_IDS)])
    named = t.customer.select(F.get(labels, (F.col("c_custkey") % 33).cast("int")).alias("abbr"))
    return named.join(team_dimension(t.spark), "abbr", "left").groupBy("team_id").agg(
        F.count("*").alias("n_customers"), F.countDistinct("abbr").alias("n_names"), F.min("abbr").alias("first_name")
    )


@query(
    "parameters_and_frames",
    """SELECT c_nationkey, count(*) AS n, sum(o_totalprice)::DECIMAL(18,2)::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus IN ('F', 'O') AND c_mktsegment <> 'it''s; --' GROUP BY 1 HAVING count(*) >= 3""",
)
def parameters_and_frames(t):
    """One text with named parameters, a list among them, and frames by name; no
    value is written into the text."""
    text = """SELECT c_nationkey, count(*) AS n, cast(cast(sum(o_totalprice) AS decimal(18,2)) AS double) AS total
        FROM {orders} JOIN {customers} ON o_custkey = c_custkey
        WHERE o_orderdate >= :since AND array_contains(:states, o_orderstatus) AND c_mktsegment <> :unwanted
        GROUP BY c_nationkey HAVING count(*) >= :least"""
    values = {"since": datetime(1996, 1, 1), "states": F.array(F.lit("F"), F.lit("O")), "unwanted": "it's; --", "least": 3}
    return typed.ask(t.spark, text, values, orders=t.orders, customers=t.customer.filter("c_acctbal IS NOT NULL"))


@query(
    "reconnects",
    """WITH m AS (SELECT user_id, ts, event_id, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    kept AS (SELECT user_id, ts, CASE WHEN n % 50 = 40 THEN n - 39 WHEN n % 50 > 40 THEN n - 40 ELSE n END AS seq FROM m WHERE n % 11 <> 5),
    told AS (SELECT *, lag(seq) OVER w AS last, lag(ts) OVER w AS before FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq))
    SELECT CASE WHEN last IS NULL THEN 'start' ELSE 'reconnect' END AS event, user_id, ts AS timestamp,
        CASE WHEN last IS NULL THEN 'first message' WHEN seq > last + 1 THEN (seq - last - 1) || ' messages missing after ' || last
             WHEN seq < last THEN 'numbered from ' || seq || ' again after ' || last
             ELSE 'silent for ' || (epoch_us(ts) - epoch_us(before)) // 1000 || ' ms' END AS details
    FROM told WHERE last IS NULL OR seq > last + 1 OR seq < last OR epoch_us(ts) - epoch_us(before) > 86400000000""",
)
def reconnects(t):
    """Interruptions of each user's events: every eleventh is lost, and every
    fiftieth or so begins to count anew."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(by)
    sent = t.events.select("user_id", "ts", n.alias("n")).filter("n % 11 <> 5")
    seq = F.when(F.col("n") % 50 == 40, F.col("n") - 39).when(F.col("n") % 50 > 40, F.col("n") - 40).otherwise(F.col("n"))
    messages = sent.select("user_id", "ts", seq.cast("bigint").alias("seq"))
    return connections.reconnects(messages, ["user_id"], "ts", silence_seconds=86400, slice_seconds=30 * 86400)


@query(
    "delete_insert",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
       UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'""",
)
def delete_insert(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    incoming = rows.filter("o_orderstatus = 'F'").drop("o_orderstatus")
    return latest.delete_insert(rows.drop("o_orderstatus"), incoming, "o_custkey")


@query(
    "missing_parents",
    "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 4)",
)
def missing_parents(t):
    children = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return latest.missing_parents(children, t.customer.filter("c_nationkey <> 4"), "c_custkey")


# Incremental planning

LAST = "lasts AS (SELECT ticker, max(shipped) AS last FROM raw_trades WHERE shipped < TIMESTAMP '1999-01-01' GROUP BY 1)"


def _stored(t):
    return fx.raw_trades(t).filter("created_time < '1999-01-01'")


@query(
    "incremental_plan",
    o.with_(RAW_TRADES, RAW_MARKETS, LAST, final="""SELECT ticker, epoch_us(last) // 1000000 - 1 AS min_ts,
        coalesce(coalesce(last, open_at) < TIMESTAMP '1998-01-01', true) AS historical, coalesce(close_at >= TIMESTAMP '1998-01-01', true) AS live
      FROM raw_markets LEFT JOIN lasts USING (ticker) WHERE ticker::BIGINT % 10 <> 0"""),
)
def incremental_plan(t):
    done = fx.raw_markets(t).filter(F.col("ticker").cast("bigint") % 10 == 0)
    return planning.trade_plan(fx.raw_markets(t), _stored(t), done, "1998-01-01T00:00:00Z")


@query(
    "new_trades",
    o.with_(RAW_TRADES, LAST, final="""SELECT r.trade_id, r.ticker, r.count_fp, r.yes_price_dollars, r.created_time
      FROM raw_trades r LEFT JOIN lasts USING (ticker) WHERE last IS NULL OR shipped >= last - INTERVAL 1 SECOND"""),
)
def new_trades(t):
    return planning.new_trades(fx.raw_trades(t), _stored(t))


@query("completed_markets", o.with_(RAW_MARKETS, final="SELECT ticker FROM raw_markets WHERE status = 'finalized'"))
def completed_markets(t):
    return planning.completed(fx.raw_markets(t))


@query(
    "game_worklist",
    f"""SELECT o_orderkey AS game_pk, {iso_sql('o_orderdate')} AS game_date FROM orders
        WHERE o_orderstatus = 'F' AND (o_orderkey % 3 <> 0 OR (o_orderkey % 6 = 0 AND o_orderdate >= TIMESTAMP '2000-06-01'))""",
)
def game_worklist(t):
    games = t.orders.select(
        F.col("o_orderkey").alias("game_pk"), fx.iso("o_orderdate").alias("game_date"),
        F.col("o_orderstatus").alias("coded_game_state"),
    )
    pulls = t.orders.filter("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("game_pk"), (F.col("o_orderkey") % 6 == 0).alias("not_found")
    )
    return planning.game_worklist(games, pulls, date(2000, 6, 15))


@query(
    "month_chunks",
    """WITH b AS (SELECT o_custkey, min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders GROUP BY 1),
       m AS (SELECT *, unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH))::DATE AS m FROM b)
       SELECT o_custkey, greatest(m, lo) AS from_date, least(last_day(m), hi) AS to_date FROM m""",
)
def month_chunks(t):
    bounds = t.orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi")
    )
    return tf.month_ranges(bounds)


@query(
    "subscriptions",
    """SELECT 'kalshi' AS platform, unnest(['KA' || user_id, 'KH' || user_id]) AS market_id FROM (SELECT DISTINCT user_id FROM events)
       UNION ALL SELECT 'polymarket', 'P' || user_id FROM (SELECT DISTINCT user_id FROM events)""",
)
def subscriptions(t):
    return planning.subscriptions(fx.matched_markets(t), "2024-01-01")


@query(
    "boundary_minutes",
    """SELECT event_id, date_diff('minute', TIMESTAMP '2024-01-01 00:00:30', ts) AS minutes, date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS hours
       FROM events""",
)
def boundary_minutes(t):
    def origin(text):
        return F.lit(text).cast("timestamp_ntz")

    return t.events.select(
        "event_id",
        tf.boundaries_between("minute", origin("2024-01-01 00:00:30"), "ts").alias("minutes"),
        tf.boundaries_between("hour", origin("2024-01-01 00:30:00"), "ts").alias("hours"),
    )


@query(
    "zone_conversion",
    """SELECT o_orderkey, timezone('UTC', timezone('America/New_York', o_orderdate + INTERVAL 12 HOUR)) AS utc,
        timezone('America/New_York', timezone('UTC', o_orderdate)) AS wall, make_timestamp(epoch_us(o_orderdate)) AS from_ms,
        o_orderdate + INTERVAL 4 HOUR AS from_iso FROM orders""",
)
def zone_conversion(t):
    at = F.col("o_orderdate")
    ms = (tf.micros(at) / F.lit(1000)).cast("bigint").cast("string")
    return t.orders.select(
        "o_orderkey",
        tf.wall_to_utc(at + tf.seconds(12 * 3600)).alias("utc"),
        tf.utc_to_wall(at).alias("wall"),
        tf.epoch_ms_to_utc(ms).alias("from_ms"),
        tf.iso_to_utc(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-04:00"))).alias("from_iso"),
    )


# Filters on names

PREFIX = "SELECT event_ticker FROM listed WHERE event_ticker LIKE 'KXMLBGAME-17JUL01%'"


@query("date_prefix", o.with_(o.DUELS, final=PREFIX))
def date_prefix_filter(t):
    wanted = date_prefix(F.lit(date(2017, 7, 1)))
    return fx.stored(t, "duel_events").filter(F.col("event_ticker").startswith(wanted)).select("event_ticker")


@query("slug_dates", o.with_(o.DUELS, final="SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM duels WHERE k % 5 <> 0 GROUP BY 1"))
def slug_dates(t):
    events = landing.league_events(landing.parse(fx.league_payloads(t), "payload", schemas.LEAGUE_EVENTS))
    return events.groupBy(slug_date("slug").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("pair_keys", o.with_(o.DUELS, final=f"""SELECT array_to_string(list_sort([{o.letters('away')}, {o.letters('home')}]), '/') AS pair,
    count(*) AS n FROM duels GROUP BY 1"""))
def pair_keys(t):
    key = F.array_join(pair_key(fx.letters(F.col("away")), fx.letters(F.col("home"))), "/")
    return fx._duels(t).groupBy(key.alias("pair")).agg(F.count(F.lit(1)).alias("n"))


# Cross-venue matching

B_SIDE = f"""moneylines AS (SELECT 'mlb-' || k || '-' || strftime(day, '%Y-%m-%d') AS event_slug, day::DATE AS game_date,
    'b-' || lpad(k::VARCHAR, 9, '0') AS slug, {o.letters('away')} AS away, {o.letters('home')} AS home,
    if(k % 3 <> 0 OR k % 6 = 0, day + to_hours(CAST(hour + 4 AS INT)), NULL) AS start_utc FROM duels WHERE k % 5 <> 0 AND k % 31 <> 0)"""
A_SIDE = """a_sides AS (SELECT p.event_ticker, p.et_date AS game_date, p.away_abbr AS away, p.home_abbr AS home,
    p.event_ticker || '-' || p.away_abbr AS away_ticker, p.event_ticker || '-' || p.home_abbr AS home_ticker, p.start_utc
  FROM parsed p WHERE p.et_date IS NOT NULL AND p.away_abbr IN (SELECT abbr FROM teams) AND p.home_abbr IN (SELECT abbr FROM teams))"""


def _venue_a(t):
    return matching.venue_a_sides(fx.stored(t, "duel_events"), fx.stored(t, "duel_markets"), fx.stored(t, "teams"))


def _venue_b(t):
    pages = landing.parse(fx.league_payloads(t), "payload", schemas.LEAGUE_EVENTS)
    return matching.venue_b_moneylines(landing.league_events(pages))


@query("venue_a_sides", o.with_(o.DUELS, o.PARSED, A_SIDE, final="SELECT * FROM a_sides"))
def venue_a_sides(t):
    return _venue_a(t)


@query("venue_b_moneylines", o.with_(o.DUELS, B_SIDE, final="SELECT * FROM moneylines"))
def venue_b_moneylines(t):
    return _venue_b(t)


# The greedy choice, one listing after the other: a state is a pair's unused events.
GREEDY = """sides AS (SELECT game_date, least(away, home) AS lo, greatest(away, home) AS hi,
      list({'e': event_ticker, 's': epoch(start_utc)}) AS unused FROM a_sides GROUP BY ALL),
  served AS (SELECT *, least(away, home) AS lo, greatest(away, home) AS hi, epoch(start_utc) AS at,
      row_number() OVER (PARTITION BY game_date, least(away, home), greatest(away, home) ORDER BY slug) AS nth FROM moneylines),
  steps AS (
    SELECT game_date, lo, hi, 0::BIGINT AS nth, unused, NULL::VARCHAR AS slug, NULL::VARCHAR AS chosen FROM sides
    UNION ALL
    SELECT game_date, lo, hi, nth, list_filter(unused, lambda x: chosen IS NULL OR x.e <> chosen), slug, chosen
    FROM (SELECT s.game_date, s.lo, s.hi, b.nth, s.unused, b.slug,
            CASE WHEN len(s.unused) = 1 THEN s.unused[1].e
                 ELSE list_sort(list_transform(list_filter(s.unused, lambda x: abs(x.s - b.at) <= 21600),
                                               lambda x: {'gap': abs(x.s - b.at), 'e': x.e}))[1].e END AS chosen
          FROM steps s JOIN served b ON s.game_date = b.game_date AND s.lo = b.lo AND s.hi = b.hi AND b.nth = s.nth + 1)),
  paired AS (SELECT slug, chosen FROM steps WHERE chosen IS NOT NULL)"""


def greedy(final: str) -> str:
    return o.with_(o.DUELS, o.PARSED, A_SIDE, B_SIDE, GREEDY, final=final).replace("WITH", "WITH RECURSIVE", 1)


@query(
    "cross_venue_match",
    greedy("""SELECT b.game_date, b.away AS away_team, b.home AS home_team, a.away_ticker AS kalshi_ticker_away,
      a.home_ticker AS kalshi_ticker_home, b.slug AS poly_slug, a.event_ticker AS kalshi_event_ticker, b.event_slug AS poly_event_slug
      FROM paired p JOIN moneylines b ON p.slug = b.slug JOIN a_sides a ON p.chosen = a.event_ticker"""),
)
def cross_venue_match(t):
    """Greedy one-to-one choice."""
    return matching.match_venues(materialize(_venue_a(t)), materialize(_venue_b(t)))


def _closed(df):
    """Listings that a later run still finds: those of every other first team."""
    return df.filter(F.ascii(F.substring(F.least("away", "home"), 5, 1)) % 2 == 0)


FOUND_AGAIN = "ascii(substr(least(b.away, b.home), 5, 1)) % 2 = 0"


@query(
    "matched_pairs_store",
    greedy(f"""SELECT b.game_date, b.away AS away_team, b.home AS home_team, a.away_ticker AS kalshi_ticker_away,
      a.home_ticker AS kalshi_ticker_home, b.slug AS poly_slug, a.event_ticker AS kalshi_event_ticker,
      b.event_slug || if({FOUND_AGAIN}, '-2', '') AS poly_event_slug, true AS same_id
      FROM paired p JOIN moneylines b ON p.slug = b.slug JOIN a_sides a ON p.chosen = a.event_ticker"""),
)
def matched_pairs_store(t):
    """Two runs into one store, the second without the games that have closed and
    with new event slugs; whether an event keeps its id."""
    path = new_path(t.spark)
    a, b = materialize(_venue_a(t)), materialize(_venue_b(t))
    collection.store_pairs(matching.match_venues(a, b), path)
    first = materialize(collection.stored_pairs(t.spark, path))
    later = _closed(b).withColumn("event_slug", F.concat("event_slug", F.lit("-2")))
    collection.store_pairs(matching.match_venues(_closed(a), later), path)
    ids = first.select("kalshi_event_ticker", F.col("id").alias("_first"))
    return collection.stored_pairs(t.spark, path).join(ids, "kalshi_event_ticker").withColumn("same_id", F.expr("id = _first")).drop("id", "_first")


@query(
    "matched_pairs_day",
    greedy("""SELECT DISTINCT x.platform, x.market_id FROM (SELECT unnest([{'platform': 'kalshi', 'market_id': a.away_ticker},
        {'platform': 'kalshi', 'market_id': a.home_ticker}, {'platform': 'polymarket', 'market_id': p.slug}]) AS x
      FROM paired p JOIN a_sides a ON p.chosen = a.event_ticker WHERE a.game_date = DATE '2017-07-01')"""),
)
def matched_pairs_day(t):
    """Two runs on one day: what the second subscribes to, closed games included."""
    path, day = new_path(t.spark), date(2017, 7, 1)
    a, b = materialize(_venue_a(t)), materialize(_venue_b(t))
    collection.run(a, b, path, day)
    return collection.run(_closed(a), _closed(b), path, day).subscriptions


@query(
    "cross_venue_single",
    o.with_(o.DUELS, o.PARSED, A_SIDE, B_SIDE, final="""SELECT a.event_ticker AS kalshi_event_ticker, min(slug) AS poly_slug
      FROM (SELECT *, least(away, home) AS lo, greatest(away, home) AS hi, count(*) OVER (PARTITION BY game_date, least(away, home), greatest(away, home)) AS n FROM a_sides) a
      JOIN moneylines b ON a.game_date = b.game_date AND lo = least(b.away, b.home) AND hi = greatest(b.away, b.home) WHERE n = 1 GROUP BY 1"""),
)
def cross_venue_single(t):
    a = materialize(_venue_a(t))
    matched = matching.match_venues(a, materialize(_venue_b(t))).select("kalshi_event_ticker", "poly_slug")
    alone = a.groupBy("game_date", F.least("away", "home"), F.greatest("away", "home")).agg(
        F.min("event_ticker").alias("kalshi_event_ticker"), F.count(F.lit(1)).alias("n")
    ).filter("n = 1")
    return matched.join(alone, "kalshi_event_ticker", "left_semi")


@query(
    "cross_venue_unmatched",
    greedy("""SELECT 'a' AS venue, event_ticker AS listing, away, home FROM a_sides WHERE event_ticker NOT IN (SELECT chosen FROM paired)
      UNION ALL SELECT 'b', slug, away, home FROM moneylines WHERE slug NOT IN (SELECT slug FROM paired)"""),
)
def cross_venue_unmatched(t):
    a, b = materialize(_venue_a(t)), materialize(_venue_b(t))
    return matching.unmatched_venues(a, b, matching.match_venues(a, b))


# Data quality


def check_rows(**checks: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", ({sql}) AS n_bad" for name, sql in checks.items())


@query(
    "dq_orphans",
    check_rows(
        lines_without_order="SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)",
        orders_without_customer="SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
        final_orders_without_lines="SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    ),
)
def dq_orphans(t):
    return union(
        quality.orphans(t.lineitem, t.orders.filter("o_orderkey % 10 <> 0"), "l_orderkey", "o_orderkey", "lines_without_order"),
        quality.orphans(t.orders, t.customer, "o_custkey", "c_custkey", "orders_without_customer"),
        quality.orphans(
            t.orders.filter("o_orderstatus = 'F'"), t.lineitem, "o_orderkey", "l_orderkey", "final_orders_without_lines"
        ),
    )


@query(
    "dq_trades",
    check_rows(
        price_range="SELECT count(*) FROM lineitem WHERE l_quantity IN (1, 50)",
        price_complement="SELECT count(*) FROM lineitem WHERE l_linenumber = 7",
        count_positive="SELECT count(*) FROM lineitem WHERE l_quantity <= 3",
        from_future="SELECT count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01'",
    ),
)
def dq_trades(t):
    """Planted: prices at the bounds, sums off by a little, no counts, times a century on."""
    price = ((F.col("l_quantity") - 1) / 49).cast("decimal(18,6)")
    off = F.when(F.col("l_linenumber") == 7, 0.00001).otherwise(0).cast("decimal(18,6)")
    rows = t.lineitem.select(
        price.alias("yes_price_dollars"), (1 - price + F.when(price.isin(0, 1), 0).otherwise(off)).cast("decimal(18,6)").alias("no_price_dollars"),
        F.greatest(F.col("l_quantity") - 3, F.lit(0)).alias("count_fp"),
        F.when(F.col("l_shipdate") >= "2001-10-01", F.col("l_shipdate") + tf.seconds(100 * 366 * 86400))
        .otherwise(F.col("l_shipdate")).alias("created_time"),
        "l_linenumber",
    )
    rows = rows.withColumn(
        "no_price_dollars",
        F.when(F.col("l_linenumber") == 7, F.col("no_price_dollars") + 0.00001).otherwise(F.col("no_price_dollars")).cast("decimal(18,6)"),
    )
    return quality.trade_checks(rows)


@query(
    "dq_markets",
    check_rows(
        close_after_open="SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0",
        finalized_has_result="SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 20 IN (0, 1)",
    ),
)
def dq_markets(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        F.col("o_orderdate").alias("open_time"),
        F.when(k % 50 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + tf.seconds(1)).alias("close_time"),
        F.when(F.col("o_orderstatus") == "F", "finalized").otherwise("active").alias("status"),
        F.when(k % 20 == 0, None).when(k % 20 == 1, "").otherwise("yes").alias("result"),
    )
    return quality.market_checks(rows)


@query(
    "dq_trade_times",
    check_rows(
        before_open="SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate",
        after_close="SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 100 DAY + INTERVAL 5 MINUTE",
    ),
)
def dq_trade_times(t):
    trades = t.lineitem.select(F.col("l_orderkey").alias("ticker"), F.col("l_shipdate").alias("created_time"))
    markets = t.orders.select(
        F.col("o_orderkey").alias("ticker"), F.col("o_orderdate").alias("open_time"),
        (F.col("o_orderdate") + tf.seconds(100 * 86400)).alias("close_time"),
    )
    return quality.trade_time_checks(trades, markets)


@query(
    "dq_games",
    o.with_(GAME_LISTS, final=check_rows(
        final_complete="SELECT count(*) FROM listings WHERE away_score IS NULL OR away_is_winner IS NULL",
        one_winner="SELECT count(*) FROM listings WHERE away_is_winner = home_is_winner",
    )),
)
def dq_games(t):
    return quality.game_checks(_schedule(t))


@query(
    "dq_play_times",
    check_rows(
        play_near_start="""SELECT count(*) FROM (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS s FROM lineitem GROUP BY 1, 2)
            JOIN orders ON l_orderkey = o_orderkey WHERE abs(date_diff('hour', o_orderdate + INTERVAL 61 DAY, s)) > 48""",
        wp_range="""SELECT count(*) FROM (SELECT l_linenumber, min(l_quantity) * 2 AS h FROM lineitem GROUP BY l_orderkey, l_linenumber)
            WHERE l_linenumber = 5 OR (l_linenumber = 6 AND h = 100)""",
        wp_complement="SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (5, 6))",
    ),
)
def dq_play_times(t):
    """Planted: chances above 100, and half a point too much."""
    n, home = F.col("at_bat_index"), F.col("home_wp")
    odds = fx.win_probability(t).withColumn("home_wp", home + F.when(n == 5, 100).when(n == 6, 0.5).otherwise(0))
    return union(quality.play_time_checks(fx.plays(t), fx.games(t)), quality.win_probability_checks(odds))


@query(
    "dq_domain",
    check_rows(
        status="SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus <> 'F'",
        market_status="SELECT count(DISTINCT o_orderkey % 10) FROM orders WHERE o_orderkey % 10 IN (3, 7)",
    ),
)
def dq_domain(t):
    """Planted: two statuses that aren't known, and markets without any."""
    end = F.substring("ticker", -1, 1)
    status = F.when(end.isin("3", "7"), F.concat(F.lit("held "), end)).when(end != "5", F.col("status"))
    return union(
        quality.unknown_values(t.orders, "o_orderstatus", ["F"], "status"),
        quality.unknown_values(fx.raw_markets(t).withColumn("status", status), "status", quality.KNOWN_STATUSES, "market_status"),
    )


@query(
    "dq_uniqueness",
    check_rows(
        line_grain="SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
        order_grain="SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)",
    ),
)
def dq_uniqueness(t):
    return union(
        quality.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], "line_grain"),
        quality.duplicates(t.orders, ["o_orderkey"], "order_grain"),
    )


@query("dq_one_sided", "SELECT count(*) AS n_bad FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) <> 2)")
def dq_one_sided(t):
    return quality.one_sided(t.lineitem, "l_orderkey", "l_linestatus")


@query("dq_team_count", o.with_(o.DUELS, final="SELECT count(DISTINCT t) AS n_distinct FROM (SELECT away_team_id AS t FROM games UNION ALL SELECT home_team_id FROM games)"))
def dq_team_count(t):
    return quality.distinct_across(fx.stored(t, "duel_games"), ["away_team_id", "home_team_id"])


@query(
    "dq_minimum_rows",
    """SELECT 'orders' AS "check", (SELECT count(*) FROM orders) AS n_rows, 1000000000 AS minimum
       UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 1000000000""",
)
def dq_minimum_rows(t):
    big = 1_000_000_000
    return quality.below_minimum({"orders": (t.orders, big), "lineitem": (t.lineitem, big), "nation": (t.nation, 1)})


def planted_sql(rel: str) -> str:
    return f"""SELECT count(*) + count(*) FILTER (game_pk % 23 = 0) FROM {rel}
        WHERE p <= 0 OR p >= 1 OR game_pk % 43 = 0 OR game_pk % 47 = 0"""


@query(
    "dq_prepared",
    o.with_(*o.CALIB, o.INNINGS, final=check_rows(
        unmapped_markets="SELECT count(*) FROM context WHERE game_pk % 19 = 0",
        pre_grain="SELECT count(*) FROM pre WHERE game_pk % 23 = 0",
        inning_grain="SELECT count(*) FROM innings WHERE game_pk % 23 = 0",
        pre_p_y=planted_sql("pre"), inning_p_y=planted_sql("innings"), window_p_y=planted_sql("window_trades"),
        null_start="SELECT count(*) + count(*) FILTER (game_pk % 23 = 0) FROM pre WHERE game_pk % 31 = 0",
        one_sided="SELECT count(*) FROM (SELECT 1 FROM pre GROUP BY game_pk HAVING count(DISTINCT side) <> 2)",
        n_teams="SELECT abs(count(DISTINCT team) - 25) FROM pre",
    )),
)
def dq_prepared(t):
    """Planted: markets without a game, rows twice, prices of 1, outcomes of 2, no start."""
    k = F.col("game_pk")

    def planted(df):
        rows = union(df, df.filter(k % 23 == 0))
        return rows.withColumns({
            "p": F.when(k % 43 == 0, 1.0).otherwise(F.col("p")), "y": F.when(k % 47 == 0, 2).otherwise(F.col("y")),
        })

    pre = planted(materialize(_pre(t))).withColumn("sched_start", F.when(k % 31 != 0, F.col("sched_start")))
    built = calibration_plan.Calibration(
        _context(t).filter(k % 19 != 0), planted(materialize(_window(t))), pre, planted(materialize(_innings(t)))
    )
    return calibration_plan.checks(snapshots.universe(fx.markets(t)), built, 25)


@query(
    "calibration_job",
    o.with_(*o.CALIB, o.INNINGS, final="""SELECT 'pre' AS name, side, count(*) AS n, round(sum(p), 6) AS total, sum(y)::BIGINT AS n_won FROM pre GROUP BY side
        UNION ALL SELECT 'window', side, count(*), round(sum(p), 6), sum(y) FROM window_trades GROUP BY side
        UNION ALL SELECT 'inning', side, count(*), round(sum(p), 6), sum(y) FROM innings GROUP BY side"""),
)
def calibration_job(t):
    """The prepared tables as the whole job writes them, gated and read back."""
    trades, markets = fx.trades(t), fx.markets(t)
    built = calibration_plan.build(
        markets, trades, fx.event_map(t), fx.games(t), fx.plays(t), fx.win_probability(t), fx.weather(t), fx.WINDOW_HOURS, fx.BIN_HOURS
    )
    # games that traded on one side only are no error of the fixture's
    staged = {"pre": quality.bad_prepared("pre") | quality.bad_start(), "window": quality.bad_prepared("window"), "inning": quality.bad_prepared("inning")}
    parts = []
    for (name, bad), df in zip(staged.items(), (built.pre, built.window_trades, built.innings), strict=True):
        stored, found = quality.written(df, bad)
        quality.gate_counts(found, bad)
        sums = stored.groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("total"), F.sum("y").cast("bigint").alias("n_won"))
        parts.append(sums.select(F.lit(name).alias("name"), "side", "n", "total", "n_won"))
    return union(*parts)


@query(
    "dq_states_episodes",
    o.with_(*o.ARB, final=check_rows(
        gross_negative="SELECT count(*) FROM states WHERE gross_arb < 0", k_spread_negative="SELECT count(*) FROM states WHERE k_ask < k_bid - 0.0002",
        p_spread_negative="SELECT count(*) FROM states WHERE p_ask < p_bid - 0.0002", duration_negative="SELECT count(*) FROM episodes WHERE end_ts < start_ts",
    )),
)
def dq_states_episodes(t):
    a = _arb(t)
    return union(quality.state_checks(a.states), quality.episode_checks(a.episodes))


@query("result_agreement", o.with_(*o.MATCH, AGREE, final="SELECT count(*) FILTER (ok) AS n_agree, count(*) FILTER (NOT ok) AS n_disagree FROM verdicts"))
def result_agreement(t):
    mapping = matching.event_map(matching.resolve(*_duel_inputs(t)))
    return matching.result_agreement(fx.stored(t, "duel_markets"), mapping, fx.stored(t, "duel_games"))
