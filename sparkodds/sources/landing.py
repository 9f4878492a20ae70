"""Landed JSON: pages, nested payloads, stream messages; validation and quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds import schemas
from sparkodds.functions.timefn import col

CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str, ddl: str, multiline: bool = False) -> DataFrame:
    """JSON files under an explicit schema; unreadable ones end up in ``_corrupt_record``."""
    return (
        spark.read.schema(f"{ddl}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multiline)
        .json(path)
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, payload), for payloads whose game is in the file name."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")
    )


def parse(df: DataFrame, payload: str, ddl: str, keep: Sequence[str] = ()) -> DataFrame:
    """Parse a text column under a schema; the fields become columns beside
    ``keep`` and ``_corrupt_record``."""
    parsed = F.from_json(
        payload, f"{ddl}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    return df.select(*keep, parsed.alias("_p")).select(*keep, "_p.*")


def page_items(pages: DataFrame, key: str, order: Column | str | None = None) -> DataFrame:
    """Items of all pages, one row each; with ``order`` also ``_order``, the
    page's and the item's position."""
    if order is None:
        return each(pages, key, "_i").select("_i.*")
    items = pages.select(col(order).alias("_page"), F.posexplode_outer(key).alias("_pos", "_i")).filter("_i IS NOT NULL")
    return items.select("_i.*", F.struct("_page", "_pos").alias("_order"))


def each(df: DataFrame, array: str, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Items of an array column. A plain explode makes Spark test the array's size
    below the projection that parses it, and so parse the JSON once more; an outer
    one with a filter above parses once."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reason``): malformed or uncastable
    records, and records that lack a required field."""
    judged = df.withColumn("reason", invalid_reason(df.columns, required))
    valid = judged.filter("reason IS NULL").drop("reason", CORRUPT)
    return valid, judged.filter("reason IS NOT NULL")


def invalid_reason(columns: Sequence[str], required: Sequence[str]) -> Column:
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed") if CORRUPT in columns else None
    for c in required:
        test, label = F.col(c).isNull(), f"missing {c}"
        reason = F.when(test, label) if reason is None else reason.when(test, label)
    return reason


def _missing(parent: Column, parts: Sequence[str]) -> Column:
    """How often the field at the end of a path is absent where its parent is there."""
    name, *rest = parts
    field = parent[name.removesuffix("[]")]
    if name.endswith("[]"):
        of_item = (lambda x: _missing(x, rest)) if rest else (lambda x: x.isNull().cast("int"))
        return F.coalesce(F.aggregate(F.transform(field, of_item), F.lit(0), lambda n, x: n + x), F.lit(0))
    return _missing(field, rest) if rest else (parent.isNotNull() & field.isNull()).cast("int")


def faults(parsed: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """(``keep``, path, reason, n): where payloads of a registered kind, parsed under
    its schema, lack required fields, lists' items included, and how often. An
    absent field's own fields are not told again; a payload that can't be read is
    one fault at the path ``$``."""
    _, required = schemas.PAYLOADS[name]
    broken = F.col(CORRUPT).isNotNull() if CORRUPT in parsed.columns else F.lit(False)
    top = sorted({p.split(".")[0].removesuffix("[]") for p in required})
    rows = parsed.select(*keep, broken.alias("_broken"), F.struct(*top).alias("_root"))
    each = [
        F.struct(F.lit(p).alias("path"), F.lit("missing").alias("reason"), F.when(F.col("_broken"), 0).otherwise(_missing(F.col("_root"), p.split("."))).alias("n"))
        for p in required
    ]
    unread = F.struct(F.lit("$").alias("path"), F.lit("malformed").alias("reason"), F.col("_broken").cast("int").alias("n"))
    told = rows.select(*keep, F.explode_outer(F.filter(F.array(unread, *each), lambda x: x["n"] > 0)).alias("_f"))
    return told.filter("_f IS NOT NULL").select(*keep, "_f.path", "_f.reason", F.col("_f.n").cast("bigint").alias("n"))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


# Nested payloads


def schedule_games(schedule: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``dates[].games[]`` to the 19 flat game columns."""
    game = each(each(schedule, "dates", "d", keep), "d.games", "g", keep)
    sides = [
        c
        for side in ("away", "home")
        for c in (
            F.col(f"g.teams.{side}.team.id").alias(f"{side}_team_id"),
            F.col(f"g.teams.{side}.team.name").alias(f"{side}_team_name"),
            F.col(f"g.teams.{side}.score").alias(f"{side}_score"),
            F.col(f"g.teams.{side}.isWinner").alias(f"{side}_is_winner"),
        )
    ]
    return game.select(
        *keep,
        F.col("g.gamePk").alias("game_pk"),
        F.col("g.gameType").alias("game_type"),
        F.col("g.gameDate").alias("game_date"),
        F.col("g.officialDate").alias("official_date"),
        F.col("g.status.codedGameState").alias("coded_game_state"),
        F.col("g.status.detailedState").alias("detailed_state"),
        *sides,
        F.col("g.venue.id").alias("venue_id"),
        F.col("g.venue.name").alias("venue_name"),
        F.col("g.doubleHeader").alias("double_header"),
        F.col("g.gameNumber").alias("game_number"),
        F.col("g.dayNight").alias("day_night"),
    )


def plays(play_by_play: DataFrame, game_pk: str = "game_pk") -> DataFrame:
    """``allPlays[]`` to the flat play columns."""
    p = each(play_by_play, "allPlays", "p", [game_pk])
    return p.select(
        F.col(game_pk).alias("game_pk"),
        F.col("p.about.atBatIndex").alias("at_bat_index"),
        F.col("p.about.inning").alias("inning"),
        F.col("p.about.halfInning").alias("half_inning"),
        F.col("p.about.startTime").alias("start_time"),
        F.col("p.about.endTime").alias("end_time"),
        F.col("p.result.event").alias("event"),
        F.col("p.result.awayScore").alias("away_score"),
        F.col("p.result.homeScore").alias("home_score"),
        F.col("p.about.isScoringPlay").alias("is_scoring_play"),
    )


def win_probability(payloads: DataFrame, payload: str = "payload", game_pk: str = "game_pk") -> DataFrame:
    """A payload that is itself an array, one row per at-bat; what can't be read
    is left to ``win_probability_split``."""
    return win_probability_split(payloads, payload, game_pk)[0]


def win_probability_split(
    payloads: DataFrame, payload: str = "payload", game_pk: str = "game_pk"
) -> tuple[DataFrame, DataFrame]:
    """(at-bat rows, quarantined rows with game_pk, ``reason`` and the payload or
    item as text): payloads that are no array or are cut short, and items without
    an at-bat index."""
    text = F.trim(payload)
    items = payloads.select(
        F.col(game_pk).alias("game_pk"),
        F.col(payload).alias("_text"),
        F.when(text.startswith("[") & text.endswith("]"), F.from_json(payload, schemas.WIN_PROBABILITY)).alias("_items"),
    )
    rows = items.select("game_pk", F.when(F.col("_items").isNull(), F.col("_text")).alias("_text"), F.explode_outer("_items").alias("w"))
    broken = F.col("_text").isNotNull()
    unnamed = F.col("w").isNotNull() & F.col("w.atBatIndex").isNull()
    judged = rows.withColumn("reason", F.when(broken, "malformed").when(unnamed, "missing atBatIndex"))
    good = judged.filter("reason IS NULL AND w IS NOT NULL").select(
        "game_pk",
        F.col("w.atBatIndex").alias("at_bat_index"),
        F.col("w.homeTeamWinProbability").alias("home_wp"),
        F.col("w.awayTeamWinProbability").alias("away_wp"),
        F.col("w.homeTeamWinProbabilityAdded").alias("home_wp_added"),
        F.col("w.playEndTime").alias("play_end_time"),
    )
    bad = judged.filter("reason IS NOT NULL").select("game_pk", "reason", F.coalesce("_text", F.to_json("w")).alias("payload"))
    return good, bad


def weather(live: DataFrame, game_pk: str = "game_pk") -> DataFrame:
    """One row per payload that has weather, none for the others."""
    held = live.select(F.col(game_pk).alias("game_pk"), F.array("gameData.weather").alias("_w"))
    return each(held, "_w", "_weather", ["game_pk"]).select("game_pk", "_weather.*")


def league_events(pages: DataFrame) -> DataFrame:
    """Nested league events with snake-case names throughout."""
    return schemas.snake_columns(each(pages, "events", "e").select("e.*"))


# Stream messages (work on batch and streaming frames alike)


def levels_json(levels: Column) -> Column:
    """``[["price","qty"],…]`` text; an absent side is an empty book."""
    return F.to_json(F.coalesce(levels, F.expr("array()").cast("array<array<string>>")))


def full_books(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Full-book messages to two rows each (bids, offers); heartbeats and
    messages without market data are skipped."""

    def pairs(c: str) -> Column:
        return F.transform(
            F.col(f"marketData.{c}"), lambda l: F.array(l["px"]["value"], l["qty"])
        )

    sides = F.array(
        F.struct(F.lit("bids").alias("side"), levels_json(pairs("bids")).alias("book_json")),
        F.struct(F.lit("offers").alias("side"), levels_json(pairs("offers")).alias("book_json")),
    )
    return (
        messages.filter(F.col("heartbeat").isNull() & F.col("marketData").isNotNull())
        .select(
            *keep,
            F.lit("polymarket").alias("platform"),
            F.coalesce("marketData.marketSlug", F.lit("")).alias("market_id"),
            F.col("marketData.transactTime").alias("source_timestamp"),
            F.inline(sides),
        )
    )


def book_updates(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Snapshot and delta messages as one update per book side: a snapshot
    replaces both sides, a delta touches one; other message types are dropped."""
    m = F.col("msg")
    snapshot = F.array(
        *[
            F.struct(
                F.lit(side).alias("side"),
                levels_json(m[f"{side}_dollars_fp"]).alias("levels"),
                F.lit(None).cast("string").alias("price"),
                F.lit(None).cast("decimal(18,2)").alias("delta"),
            )
            for side in ("yes", "no")
        ]
    )
    delta = F.array(
        F.struct(
            m["side"].alias("side"),
            F.lit(None).cast("string").alias("levels"),
            m["price_dollars"].alias("price"),
            m["delta_fp"].cast("decimal(18,2)").alias("delta"),
        )
    )
    kind = F.col("type")
    return messages.filter(kind.isin("orderbook_snapshot", "orderbook_delta")).select(
        *keep,
        m["market_ticker"].alias("market_id"),
        F.timestamp_add("MILLISECOND", m["ts_ms"], F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).alias("source_ts"),
        (kind == "orderbook_snapshot").alias("is_snapshot"),
        F.inline(F.when(kind == "orderbook_snapshot", snapshot).otherwise(delta)),
    )


def errors(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("type") == "error")


def unreadable(messages: DataFrame) -> DataFrame:
    """Messages that are no JSON of their schema, as (``reason``, the line, its
    ``type`` if that could be read); for frames with ``_corrupt_record``, as
    ``streaming.landing.read_messages`` gives."""
    broken = messages.filter(F.col(CORRUPT).isNotNull())
    return broken.select(F.lit("malformed").alias("reason"), F.col(CORRUPT).alias("line"), "type")
