"""Event tickers, team pairs and slugs as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.functions.timefn import col, wall_to_utc

# Ticker grammar, month names, team ids, non-game suffixes.
SERIES = "KXMLBGAME"
EVENT_PATTERN = r"^KXMLBGAME-(\d{2})([A-Z]{3})(\d{2})(\d{4})?([A-Z]+?)(?:G?(\d))?$"
SUFFIX_PATTERN = r"-([A-Z]+)$"
MONTHS = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6,
    "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
}
TEAM_IDS = {
    "LAA": 108, "ARI": 109, "AZ": 109, "BAL": 110, "BOS": 111, "CHC": 112,
    "CIN": 113, "CLE": 114, "COL": 115, "DET": 116, "HOU": 117, "KC": 118,
    "LAD": 119, "WSH": 120, "NYM": 121, "ATH": 133, "PIT": 134, "SD": 135,
    "SEA": 136, "SF": 137, "STL": 138, "TB": 139, "TEX": 140, "TOR": 141,
    "MIN": 142, "PHI": 143, "ATL": 144, "CWS": 145, "MIA": 146, "NYY": 147,
    "MIL": 158,
}
NON_GAME_SUFFIXES = ["ALHS", "ALLS", "NLHS", "NLLS"]


def market_suffix(ticker: Column | str) -> Column:
    return F.regexp_extract(col(ticker), SUFFIX_PATTERN, 1)


def parse_event_ticker(ticker: Column | str, pattern: str = EVENT_PATTERN) -> Column:
    """``struct(start_utc, et_date, pair, game_number)``, or NULL when the text is
    not such a ticker or names an impossible date or time. ``start_utc`` is NULL
    for tickers that carry a date only.

    The pattern runs once per row: its groups are written out side by side and
    split, and the rest works on the parts; their time is made once too."""
    ticker = col(ticker)
    groups = F.split(F.regexp_replace(ticker, pattern, "$1|$2|$3|$4|$5|$6"), r"\|")
    return F.get(F.transform(F.transform(F.array(groups), _with_wall), _from_parts), F.lit(0))


def _with_wall(parts: Column) -> Column:
    def part(i: int) -> Column:
        return F.get(parts, F.lit(i - 1))

    def number(i: int) -> Column:
        # a failing try_cast costs an exception, and most tickers lack some part
        return F.when((F.size(parts) == 6) & (part(i) != ""), part(i).try_cast("int"))

    month = F.try_element_at(
        F.create_map(*[F.lit(x) for x in chain.from_iterable(MONTHS.items())]), part(2)
    )
    year = number(1) + 2000
    day = number(3)
    hhmm = part(4)
    timed = hhmm != ""
    hour = F.when(timed, F.substring(hhmm, 1, 2).try_cast("int")).otherwise(0)
    minute = F.when(timed, F.substring(hhmm, 3, 2).try_cast("int")).otherwise(0)
    wall = F.call_function(
        "try_make_timestamp_ntz", year, month, day, hour, minute, F.lit(0).cast("decimal(16,6)")
    )
    # hour 24 and minute 60 style values are malformed too
    made = F.when((hour < 24) & (minute < 60), wall)
    return F.struct(made.alias("wall"), timed.alias("timed"), part(5).alias("pair"), number(6).alias("game_number"))


def _from_parts(of: Column) -> Column:
    return F.when(
        of["wall"].isNotNull(),
        F.struct(
            F.when(of["timed"], wall_to_utc(of["wall"])).alias("start_utc"),
            of["wall"].cast("date").alias("et_date"),
            of["pair"].alias("pair"),
            of["game_number"].alias("game_number"),
        ),
    )


def split_pair(pair: Column | str, suffixes: Column | str) -> Column:
    """``struct(away, home)`` when the two distinct suffixes, in some order, spell
    the pair; otherwise NULL."""
    pair, s = col(pair), F.array_distinct(col(suffixes))
    a, b = F.array_min(s), F.array_max(s)

    def sides(away: Column, home: Column) -> Column:
        return F.struct(away.alias("away"), home.alias("home"))

    return F.when(
        F.size(s) == 2,
        F.when(pair == F.concat(a, b), sides(a, b)).when(pair == F.concat(b, a), sides(b, a)),
    )


def pair_key(a: Column | str, b: Column | str) -> Column:
    """Order-free key of two teams."""
    return F.sort_array(F.array(col(a), col(b)))


def date_prefix(day: Column | str, series: str = SERIES) -> Column:
    """Prefix shared by one day's event tickers, e.g. KXMLBGAME-26JUL30."""
    return F.concat(F.lit(series + "-"), F.upper(F.date_format(col(day), "yyMMMdd")))


def slug_date(slug: Column | str) -> Column:
    """The ISO date in the last three dash-separated parts of a slug, as text."""
    return F.substring_index(col(slug), "-", -3)


def team_dimension(spark: SparkSession, teams: dict[str, int] = TEAM_IDS) -> DataFrame:
    """abbr → team_id, many to one."""
    return spark.createDataFrame(sorted(teams.items()), "abbr string, team_id int")


def game_key(away: Column | str, home: Column | str, day: Column | str) -> Column:
    return F.concat(col(away), F.lit("@"), col(home), F.lit("-"), col(day).cast("string"))
