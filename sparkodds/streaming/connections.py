"""Interruptions of a feed as rows that the stream itself writes.

The streaming twin of ``operators.connections.reconnects``; besides, a feed that
falls silent is reported while the silence lasts, by an event-time timer, as a
``silence`` row: other feeds' messages move the time on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from sparkodds.functions.timefn import from_micros
from sparkodds.operators.connections import SILENCE_SECONDS
from sparkodds.streaming.ordered import InOrder, in_order


class Connection(InOrder):
    """Holds the last message's number and time."""

    def __init__(self, fields: Sequence[tuple[str, str]], order: Sequence[str], names: Sequence[str], stamp: str, number: str, silence_ms: int):
        super().__init__(fields, order, names)
        self.stamp, self.number, self.silence_ms = stamp, number, silence_ms

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, at bigint, expected bigint")

    def apply(self, key: Any, at: int, rows: list[dict[str, Any]]) -> Iterator[Row]:
        before, then, timer = tuple(self.last.get()) if self.last.exists() else (None, None, None)
        for r in rows:
            here, now = r[self.number], r[self.stamp]
            silent = None if then is None else (now - then) // 1000
            if timer is not None and silent > self.silence_ms:  # told before its timer has come
                yield self._silence(key, before, then)
            if before is None:
                yield self.row("start", *key, now, "first message")
            elif here > before + 1:
                yield self.row("reconnect", *key, now, f"{here - before - 1} messages missing after {before}")
            elif here < before:
                yield self.row("reconnect", *key, now, f"numbered from {here} again after {before}")
            elif silent > self.silence_ms:
                yield self.row("reconnect", *key, now, f"silent for {silent} ms")
            before, then, timer = here, now, at + 1 + self.silence_ms
        self.handle.registerTimer(timer)  # those of earlier messages come to nothing
        self.last.update((before, then, timer))

    def _silence(self, key: Any, before: int, then: int) -> Row:
        return self.row("silence", *key, then + self.silence_ms * 1000, f"nothing after {before}")

    def due(self, key: Any, at: int) -> Iterator[Row]:
        if self.last.exists():
            seq, then, timer = self.last.get()
            if at == timer:
                yield self._silence(key, seq, then)
                self.last.update((seq, then, None))


def reconnect_stream(
    messages: DataFrame,
    keys: Sequence[str] = ("platform",),
    ts: str = "source_ts",
    seq: str = "seq",
    silence_seconds: float = SILENCE_SECONDS,
    delay: str = "10 seconds",
) -> DataFrame:
    """(event, keys, timestamp, details), to be appended to the metadata table."""
    used = messages.filter(F.col(seq).isNotNull()).select(*keys, ts, F.col(seq).cast("bigint").alias(seq))
    kinds = dict(used.dtypes)
    output = ", ".join(["event string", *(f"`{k}` {kinds[k]}" for k in keys), "timestamp bigint", "details string"])
    made = in_order(used, keys, ts, [ts, seq], Connection, output, delay, stamp=ts, number=seq, silence_ms=int(silence_seconds * 1000))
    return made.withColumn("timestamp", from_micros("timestamp"))
