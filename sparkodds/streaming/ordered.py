"""Rows of a key by event time, whatever files and micro-batches bring them.

A row waits in state under the millisecond of its event time, and an event-time
timer is set for it. When the watermark has passed, no earlier row can come any
more, and Spark fires a key's timers in their order; so rows are applied in order
across micro-batches, and nothing but the rows of one millisecond is sorted.
State holds the rows of the last ``delay`` only. Rows that come later than that
are dropped by Spark, which counts them (``numRowsDroppedByWatermark``): they are
never applied after newer ones.

The watermark follows all keys, so a quiet market's rows come out as soon as any
market goes on. A source that ends keeps the rows of its last ``delay`` until
something newer, such as a heartbeat, moves the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkodds.functions.timefn import micros

AT = "_at"


class InOrder(StatefulProcessor):
    """Calls ``apply`` with a key's rows of one millisecond, each a dict, sorted by
    ``order``; milliseconds come in order."""

    def __init__(self, fields: Sequence[tuple[str, str]], order: Sequence[str], names: Sequence[str]):
        self.fields, self.order, self.names = list(fields), list(order), list(names)

    def row(self, *values: Any) -> Row:
        """A row of the output; Spark reads its columns by name."""
        return Row(**dict(zip(self.names, values, strict=True)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = ", ".join(f"`{name}`: {kind}" for name, kind in self.fields)
        self.waiting = handle.getMapState("waiting", "at bigint", f"rows array<struct<{kept}>>")
        self.start(handle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at, held = None, []
        for r in rows:
            if r[AT] != at:
                self._wait(at, held)
                at, held = r[AT], []
            held.append(tuple(r[name] for name, _ in self.fields))
        self._wait(at, held)
        return iter(())

    def _wait(self, at: int | None, rows: list[tuple]) -> None:
        if at is None:
            return
        if self.waiting.containsKey((at,)):
            rows = [*(tuple(r) for r in self.waiting.getValue((at,))[0]), *rows]
        else:
            self.handle.registerTimer(at + 1)  # rows of the millisecond may come until then
        self.waiting.updateValue((at,), (rows,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((due - 1,)):
            names = [name for name, _ in self.fields]
            rows = [dict(zip(names, r, strict=True)) for r in self.waiting.getValue((due - 1,))[0]]
            self.waiting.removeKey((due - 1,))
            rows.sort(key=lambda r: tuple(r[c] for c in self.order))
            yield from self.apply(key, due - 1, rows)
        yield from self.due(key, due)

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Open more state."""

    def apply(self, key: Any, at: int, rows: list[dict[str, Any]]) -> Iterator[Row]:
        raise NotImplementedError

    def due(self, key: Any, at: int) -> Iterator[Row]:
        """A timer has come, set by ``apply`` perhaps."""
        return iter(())

    def close(self) -> None:
        """Nothing is held outside the state."""


def in_order(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    processor: type[InOrder],
    output: str,
    delay: str,
    **options: Any,
) -> DataFrame:
    """A stream's rows through a processor, by key and event time. Rows without an
    event time have no place in an order and are left out. ``output`` is the DDL of
    what it yields; naive times travel as microseconds."""
    timed = rows.filter(F.col(ts).isNotNull()).withColumn("_event_time", F.timestamp_micros(micros(ts))).withWatermark("_event_time", delay)
    own = [f for f in rows.schema.fields if f.name not in keys]
    naive = [f.name for f in own if f.dataType.typeName() == "timestamp_ntz"]
    timed = timed.withColumns({AT: F.expr("unix_millis(_event_time)"), **{c: micros(c) for c in naive}})
    fields = [(f.name, "bigint" if f.name in naive else f.dataType.simpleString()) for f in own]
    names = T.StructType.fromDDL(output).names
    return timed.groupBy(*keys).transformWithState(
        statefulProcessor=processor(fields, order, names, **options), outputStructType=output, outputMode="Append", timeMode="EventTime"
    )
