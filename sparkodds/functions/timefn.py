"""Time expressions. All timestamps are naive UTC (TIMESTAMP_NTZ), so results do
not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _span_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end as an exact decimal. Subtracting naive
    timestamps involves no zone, while ``timestampdiff`` would pass through the
    session's and shift times in its daylight-saving gap."""
    return (end - start).cast("interval second").cast("decimal(18,6)")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a naive timestamp."""
    origin = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (_span_seconds(origin, col(ts)) * 1_000_000).cast("bigint")


def from_micros(n: Column | str) -> Column:
    """Naive UTC timestamp from microseconds since 1970-01-01."""
    return F.timestamp_add("MICROSECOND", col(n), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def seconds(n: float) -> Column:
    """Interval literal of ``n`` seconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n).cast("decimal(18,6)"))


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds from start to end as a double."""
    return _span_seconds(col(start), col(end)).cast("double")


def boundaries_between(unit: str, start: Column | str, end: Column | str) -> Column:
    """Number of unit boundaries crossed from start to end. Unlike
    ``timestampdiff`` this counts boundaries, not whole units elapsed:
    10:00:59 to 10:01:00 is one minute."""
    width = F.lit(MICROS[unit])
    return F.floor(micros(end) / width) - F.floor(micros(start) / width)


def time_slice(ts: Column | str, width_seconds: float) -> Column:
    """Index of the fixed-width time slice that holds ``ts``."""
    return F.floor(micros(ts) / F.lit(float(width_seconds) * 1e6)).cast("bigint")


def wall_to_utc(ts: Column | str, zone: str = "America/New_York") -> Column:
    """Naive wall time in ``zone`` to naive UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), col(ts))


def utc_to_wall(ts: Column | str, zone: str = "America/New_York") -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(ts))


def epoch_ms_to_utc(ms: Column | str) -> Column:
    """Epoch milliseconds (a number or its text) to naive UTC."""
    return F.timestamp_add(
        "MILLISECOND", col(ms).try_cast("bigint"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    )


def iso_to_utc(text: Column | str) -> Column:
    """ISO-8601 text to naive UTC; text without an offset is taken as UTC,
    unreadable text gives NULL. Plain casts and string tests, no regex, and by
    way of microseconds, so the session time zone plays no part."""
    text = F.trim(col(text))
    clock = F.substring(text, 12, 40)
    zoned = F.endswith(text, F.lit("Z")) | (F.instr(clock, "+") > 0) | (F.instr(clock, "-") > 0)
    utc = (
        F.when(zoned, text)
        .when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z")))
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return from_micros(F.unix_micros(utc.try_cast("timestamp")))


def month_ranges(bounds, lo: str = "lo", hi: str = "hi"):
    """Calendar-month ranges ``(from_date, to_date)`` covering [lo, hi] of every
    row of ``bounds``, the first and last clipped."""
    months = F.explode(F.expr(f"sequence(trunc({lo}, 'MM'), {hi}, interval 1 month)")).alias("_m")
    rest = [c for c in bounds.columns if c not in (lo, hi)]
    return (
        bounds.filter(F.col(lo) <= F.col(hi)).select(*rest, lo, hi, months)
        .select(
            *rest,
            F.greatest("_m", lo).alias("from_date"),
            F.least(F.last_day("_m"), F.col(hi)).alias("to_date"),
        )
    )
