"""Where a feed was interrupted, told from its messages.

A connection numbers its messages from 1 on. A number that isn't the next one, or a
silence longer than a feed ever keeps, means that books may have missed updates:
the first message after it is a ``reconnect`` row, as ``collection_metadata`` holds
them and ``operators.episodes.blackout_centers`` reads them. A number that comes
again is a message delivered twice and no interruption.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkodds.functions.timefn import micros
from sparkodds.operators.slices import DEFAULT_SLICE_SECONDS, previous_row

#: Longer than the heartbeats of a feed are apart.
SILENCE_SECONDS = 30.0


def reconnects(
    messages: DataFrame,
    keys: Sequence[str] = ("platform",),
    ts: str = "source_ts",
    seq: str = "seq",
    silence_seconds: float = SILENCE_SECONDS,
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
) -> DataFrame:
    """(event, keys, timestamp, details) of the interruptions in ``messages``, in
    the order of their times; messages of one time go by their number. Messages
    without a time or a number tell nothing. A key's first message is its start."""
    known = messages.filter(F.col(ts).isNotNull() & F.col(seq).isNotNull()).select(*keys, ts, seq).distinct()
    found = previous_row(known, keys, ts, [ts, seq], [ts, seq], "_before", slice_seconds)
    before, here = F.col(f"_before.{seq}"), F.col(seq)
    silent = F.floor((micros(ts) - micros(f"_before.{ts}")) / 1000)
    details = (
        F.when(F.col("_before").isNull(), F.lit("first message"))
        .when(here > before + 1, F.format_string("%d messages missing after %d", here - before - 1, before))
        .when(here < before, F.format_string("numbered from %d again after %d", here, before))
        .when(silent > int(silence_seconds * 1000), F.format_string("silent for %d ms", silent))
    )
    event = F.when(F.col("_before").isNull(), "start").otherwise("reconnect")
    return found.withColumn("details", details).filter("details IS NOT NULL").select(
        event.alias("event"), *keys, F.col(ts).alias("timestamp"), "details"
    )
