"""Structured Streaming: order-book replay and top-of-book changes.

Both apply their updates by event time (``streaming.ordered``), so the result does
not depend on how the updates are cut into files and micro-batches, as long as
none is later than ``delay``. State is keyed by (market, side), which spreads a
market over two keys, and a micro-batch is bounded by the source's rate limit
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from sparkodds.functions.books import complement, levels, top_of
from sparkodds.functions.timefn import from_micros
from sparkodds.operators.replay import BOOK, ORDER, apply_update, book_text
from sparkodds.streaming.ordered import InOrder, in_order

DELAY = "10 seconds"


class BookReplay(InOrder):
    """Holds one side's levels; yields the whole side after each applied update."""

    def __init__(self, fields: Sequence[tuple[str, str]], order: Sequence[str], names: Sequence[str], keep: Sequence[str]):
        super().__init__(fields, order, names)
        self.keep = list(keep)

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.side = handle.getValueState("side", "prices array<string>, quantities array<bigint>")

    def apply(self, key: Any, at: int, rows: list[dict[str, Any]]) -> Iterator[Row]:
        book = dict(zip(*self.side.get(), strict=True)) if self.side.exists() else None
        for r in rows:
            if book is None and not r["is_snapshot"]:
                continue
            book = apply_update(book or {}, r["levels"] if r["is_snapshot"] else None, r["price"], r["delta"])
            yield self.row(*key, *(r[c] for c in (*ORDER, *self.keep)), book_text(book))
        if book is not None:
            self.side.update((list(book), list(book.values())))


def _times_back(made: DataFrame, like: DataFrame) -> DataFrame:
    """Columns that travelled as microseconds in their type, in the order of ``made``."""
    naive = {f.name for f in like.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return made.select(*(from_micros(c).alias(c) if c in naive else F.col(c) for c in made.columns))


def _output(like: DataFrame, columns: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in like.schema.fields}
    return ", ".join(f"`{c}` {'bigint' if kinds[c] == 'timestamp_ntz' else kinds[c]}" for c in columns)


def replay_stream(updates: DataFrame, delay: str = DELAY, keep: Sequence[str] = ()) -> DataFrame:
    """Streaming twin of ``operators.replay.replay``: the same rows with the
    update's ``keep`` columns, such as the receive time and the platform."""
    cents = updates.withColumn("delta", (F.col("delta") * 100).cast("bigint"))
    used = cents.select(*BOOK, *ORDER, "is_snapshot", "levels", "price", "delta", *keep)
    output = f"{_output(used, [*BOOK, *ORDER, *keep])}, book_json string"
    made = in_order(used, BOOK, "source_ts", ["source_ts", "seq"], BookReplay, output, delay, keep=keep)
    rows = _times_back(made, used)
    return rows.select(*BOOK, *ORDER, "book_json", *keep)


class TopChanges(InOrder):
    """Holds a leg's last price and size; yields the rows that change either."""

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double, size double")

    def apply(self, key: Any, at: int, rows: list[dict[str, Any]]) -> Iterator[Row]:
        known = self.last.exists()
        last = tuple(self.last.get()) if known else None
        for r in rows:
            now = (r["price"], r["size"])
            if not known or now != last:
                yield self.row(*key, r["timestamp"], r["seq"], *now)
            known, last = True, now
        self.last.update(last)


def top_changes_stream(quotes: DataFrame, delay: str = DELAY) -> DataFrame:
    """Streaming twin of ``operators.books.bbo_changes`` on quotes with a ``seq``."""
    keys = ["game_key", "update_type"]
    used = quotes.select(*keys, "timestamp", "seq", "price", "size")
    made = in_order(used, keys, "timestamp", ["timestamp", "seq"], TopChanges, _output(used, used.columns), delay)
    return _times_back(made, used)


def stream_quotes(books: DataFrame, dimension: DataFrame) -> DataFrame:
    """Quotes of a stream of whole books: stream-static join on the book dimension."""
    return (
        books.join(dimension, ["platform", "market_id", "side"])
        .withColumn("_levels", levels("book_json"))
        .withColumn("_top", top_of("_levels", F.col("platform") == "kalshi"))
        .select(
            "game_key",
            "update_type",
            F.col("source_ts").alias("timestamp"),
            "seq",
            F.when(F.col("update_type") == "k_ask", complement("_top.price"))
            .otherwise(F.col("_top.price")).alias("price"),
            F.col("_top.size").alias("size"),
        )
    )
