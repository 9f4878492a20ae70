"""The refresh job: landed items → raw tables → entity map, published only when
the match is good enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds import schemas
from sparkodds.operators import matching, planning, quality
from sparkodds.operators.latest import merge_tiers
from sparkodds.operators.unions import union
from sparkodds.session import materialize
from sparkodds.sources import landing, sinks


def ordered(df: DataFrame, name: str) -> DataFrame:
    """A registered table's columns, and where the row stood in its pages."""
    return df.select(*schemas.conformed(df, name), *(c for c in df.columns if c == "_order"))


def land_markets(events: DataFrame, historical: DataFrame, live: DataFrame, path: str) -> DataFrame:
    """Upsert one run's listings into the raw tables below ``path`` and give the
    markets back. The live tier wins over the historical one, then the last in its
    pages where the items have ``_order`` (``landing.page_items``)."""
    events = quality.written_rows(ordered(events, "events"), "events")
    tiers = [ordered(historical, "markets"), ordered(live, "markets")]
    paged = ["_order"] if all("_order" in t.columns for t in tiers) else []
    tiers = tiers if paged else [t.drop("_order") for t in tiers]
    markets = quality.written_rows(merge_tiers(tiers, ["ticker"], paged).drop("_order"), "markets")
    sinks.upsert_table(events, f"{path}/events", ["event_ticker"], order=[c for c in events.columns if c == "_order"])
    sinks.upsert_table(markets, f"{path}/markets", ["ticker"])
    return markets


def plan_trades(spark: SparkSession, path: str, run_id: str, cutoff: str) -> DataFrame:
    """Plan a run from the stored tables: which parts of which markets to pull and
    from when. The plan is stored as ``trade_runs`` and given back."""

    def stored(name: str) -> DataFrame:
        empty = spark.createDataFrame([], schemas.table_schema(name))
        return schemas.conform(sinks.table(spark, f"{path}/{name}"), name) if sinks.exists(spark, f"{path}/{name}") else empty

    plan = planning.trade_plan(stored("markets"), stored("trades"), stored("kalshi_trade_pulls"), cutoff)
    run = planning.run_phases(plan).select(F.lit(run_id).alias("run_id"), "ticker", "phase", "min_ts", F.lit("planned").alias("state"), F.lit(0).cast("bigint").alias("n_pages"))
    sinks.upsert_table(run, f"{path}/trade_runs", ["run_id", "ticker", "phase"], ["run_id"])
    return sinks.table(spark, f"{path}/trade_runs").filter(F.col("run_id") == run_id)


def land_trades(pages: DataFrame, path: str, run_id: str) -> DataFrame:
    """Upsert a run's trade pages, (ticker, phase, page, is_last, trades), and mark
    what they complete: finalized markets of which every planned part is there to
    its last page. Trades are stored by date, so a run rewrites the days it has
    trades of. Marks come last, so a run that fails earlier marks nothing, and
    pages that come later complete it. Gives the run's states."""
    spark = pages.sparkSession
    pages = materialize(pages)
    items = pages.select("page", F.posexplode("trades").alias("_pos", "_i")).select("_i.*", F.struct("page", "_pos").alias("_order"))
    trades = ordered(items, "trades").withColumn("trade_date", F.substring("created_time", 1, 10))
    if not trades.isEmpty():
        sinks.upsert_table(trades, f"{path}/trades", ["trade_id"], partition_by=["trade_date"], order=["_order"], check_moves=False)
    runs = sinks.table(spark, f"{path}/trade_runs").filter(F.col("run_id") == run_id)
    seen = pages.select("ticker", "phase", "page", "is_last").withColumn("run_id", F.lit(run_id))
    sinks.upsert_table(seen, f"{path}/trade_pages", ["run_id", "ticker", "phase", "page"], ["run_id"])
    arrived = sinks.table(spark, f"{path}/trade_pages").filter(F.col("run_id") == run_id)
    states = materialize(planning.run_states(runs, arrived))
    kept = runs.drop("state", "n_pages").join(states, ["ticker", "phase"])
    sinks.upsert_table(kept, f"{path}/trade_runs", ["run_id", "ticker", "phase"], ["run_id"])
    done = planning.completed_in_run(states, sinks.table(spark, f"{path}/markets"))
    sinks.upsert_table(done, f"{path}/kalshi_trade_pulls", ["ticker"])
    return states


def land_games(schedules: DataFrame, responses: DataFrame, path: str) -> None:
    """Upsert one run's schedule pages and per-game payloads below ``path``.

    schedules: page, payload. responses: game_pk, not_found, and the payloads
    ``plays``, ``win_probability`` and ``live`` as text, NULL where there was none.
    What can't be read goes to ``quarantine`` with its reason; required fields that
    schedule pages lack are counted by path in ``payload_faults``. The pulls are marked
    last: a run that fails earlier is pulled again, a game that wasn't found is
    tried again while it is recent (``planning.game_worklist``)."""
    pages = landing.parse(schedules, "payload", schemas.SCHEDULE, ["page"])
    sinks.append(landing.faults(pages, "schedule", ["page"]), f"{path}/payload_faults")
    listed = materialize(landing.schedule_games(pages.filter(F.col(landing.CORRUPT).isNull()), ["page"]))
    games = quality.written_rows(planning.schedule_games(listed, "page"), "mlb_games")
    sinks.upsert_table(schemas.conform(games, "mlb_games"), f"{path}/mlb_games", ["game_pk"])
    responses = materialize(responses)
    found = responses.filter("NOT not_found")
    odds, bad_odds = landing.win_probability_split(found.filter("win_probability IS NOT NULL"), "win_probability")

    def readable(payload: str, ddl: str) -> tuple[DataFrame, DataFrame]:
        parsed = landing.parse(found.filter(F.col(payload).isNotNull()), payload, ddl, ["game_pk", payload])
        broken = F.col(landing.CORRUPT).isNotNull()
        bad = parsed.filter(broken).select("game_pk", F.lit("malformed").alias("reason"), F.col(payload).alias("payload"))
        return parsed.filter(~broken), bad

    plays, bad_plays = readable("plays", schemas.PLAY_BY_PLAY)
    live, bad_live = readable("live", schemas.LIVE_FEED)
    for name, rows, keys in (
        ("mlb_plays", landing.plays(plays), ["game_pk", "at_bat_index"]),
        ("mlb_win_probability", odds, ["game_pk", "at_bat_index"]),
        ("mlb_weather", landing.weather(live), ["game_pk"]),
    ):
        sinks.upsert_table(schemas.conform(rows, name), f"{path}/{name}", keys)
    bad = [b.withColumn("source", F.lit(n)) for n, b in (("plays", bad_plays), ("win_probability", bad_odds), ("live", bad_live))]
    sinks.append(union(*bad), f"{path}/quarantine")
    sinks.upsert_table(schemas.conform(responses, "mlb_game_pulls"), f"{path}/mlb_game_pulls", ["game_pk"])


def publish_map(
    events: DataFrame,
    markets: DataFrame,
    games: DataFrame,
    plays: DataFrame,
    teams: DataFrame,
    path: str,
    min_rate: float = quality.MIN_MATCH_RATE,
) -> DataFrame:
    """Resolve raw events to raw games and replace the map at ``path``. The gates
    run on the new map before it replaces the old one."""
    resolved = materialize(
        matching.resolve(matching.load_events(events, markets), matching.load_games(games, plays), teams)
    )
    matching.gate_match(matching.match_report(resolved, markets, games), min_rate)
    return sinks.rebuild(schemas.conform(matching.event_map(resolved), "kalshi_mlb_map"), path)
