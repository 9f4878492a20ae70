"""Order-book replay of snapshots and deltas, as a batch job.

Updates (see ``sources.landing.book_updates``): market_id, side, source_ts, seq,
is_snapshot, levels (JSON of [price, qty] pairs), price, delta. Within a book
side they apply in (source_ts, seq) order: a snapshot replaces the side (of a price listed twice the last listing counts), a delta
adds to one level, a level at or below zero goes, a delta before any snapshot is
ignored.

One busy market may hold a third of all updates, so a market is never replayed
by one task. With a snapshot's quantity as first step, a level is a running sum
that may not fall below zero: q = S - min(0, least S so far). Running sums and
minima carry across time slices, so every level's quantity after every update is
plain windows over (level, slice). From those comes each slice's opening book,
and slices then replay independently.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkodds.functions.books import levels as parse_levels
from sparkodds.functions.timefn import time_slice
from sparkodds.operators.slices import (
    DEFAULT_SLICE_SECONDS,
    earlier,
    running_sum,
    sliced_scan,
    so_far,
)
from sparkodds.operators.unions import union
from sparkodds.session import materialize

BOOK = ["market_id", "side"]
ORDER = ["source_ts", "seq"]
REPLAY_SCHEMA = "market_id string, side string, source_ts timestamp_ntz, seq bigint, book_json string"


def last_listings(levels: Column) -> Column:
    """A side's parsed levels, each price once: as it is listed last."""
    return F.filter(
        levels,
        lambda level, i: ~F.exists(F.slice(levels, i + 2, F.size(levels)), lambda later: F.get(later, F.lit(0)) == F.get(level, F.lit(0))),
    )


def with_epoch(updates: DataFrame, slice_seconds: float = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """Updates numbered by the snapshot they follow; those before any are dropped."""
    counted = running_sum(
        updates, BOOK, "source_ts", ORDER, F.col("is_snapshot").cast("bigint"), "epoch", slice_seconds
    )
    return counted.filter("epoch > 0")


def level_states(updates: DataFrame, slice_seconds: float = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """Quantity (in hundredths) of a level after each update that touches it.
    ``updates`` as from ``with_epoch``, materialized."""
    parsed = updates.filter("is_snapshot").select(*BOOK, "epoch", *ORDER, parse_levels("levels").alias("_ls"))
    from_snapshots = (
        parsed.select(*BOOK, "epoch", *ORDER, F.explode_outer(last_listings(F.col("_ls"))).alias("_l"))
        .filter("_l IS NOT NULL")
        .select(
            *BOOK, "epoch", *ORDER,
            F.get("_l", F.lit(0)).alias("price"),
            F.get("_l", F.lit(1)).cast("decimal(18,2)").alias("step"),
        )
    )
    from_deltas = updates.filter("NOT is_snapshot").select(
        *BOOK, "epoch", *ORDER, "price", F.col("delta").alias("step")
    )
    steps = union(from_snapshots, from_deltas).withColumn(
        "step", (F.col("step") * 100).cast("bigint")
    )
    level = [*BOOK, "epoch", "price"]
    summed = materialize(running_sum(steps, level, "source_ts", ORDER, "step", "_s", slice_seconds))
    scanned = sliced_scan(
        summed,
        level,
        "source_ts",
        ORDER,
        local={"_low": lambda w: F.min("_s").over(so_far(w))},
        tail={"_least": F.min("_s")},
        carry={"_before": earlier("_least", F.min)},
        slice_seconds=slice_seconds,
    )
    floor = F.least(F.lit(0).cast("bigint"), "_low", "_before")
    return scanned.select(*level, *ORDER, (F.col("_s") - floor).alias("qty"))


def opening_books(
    updates: DataFrame, level_df: DataFrame, slice_seconds: float = DEFAULT_SLICE_SECONDS
) -> DataFrame:
    """(book, slice, levels JSON) standing at the start of every slice that has
    updates and follows a snapshot."""
    per_slice = updates.groupBy(*BOOK, time_slice("source_ts", slice_seconds).alias("slice")).agg(
        F.max("epoch").alias("epoch")
    )
    by_book = Window.partitionBy(*BOOK).orderBy("slice")
    slices = per_slice.select(
        *BOOK, "slice", F.row_number().over(by_book).alias("idx"), "epoch",
        F.lag("epoch").over(by_book).alias("opening_epoch"),
    )
    # an epoch's book opens every slice up to the one after its last whole slice
    lasting = slices.groupBy(*BOOK, "epoch").agg(F.max("idx").alias("last_idx"))
    last_in_slice = (
        level_df.groupBy(*BOOK, "epoch", "price", time_slice("source_ts", slice_seconds).alias("slice"))
        .agg(F.max_by("qty", F.struct(*ORDER)).alias("qty"))
        .join(slices.select(*BOOK, "slice", "idx"), [*BOOK, "slice"])
    )
    by_level = Window.partitionBy(*BOOK, "epoch", "price").orderBy("idx")
    spans = (
        last_in_slice.withColumn("_next", F.lead("idx").over(by_level))
        .join(lasting, [*BOOK, "epoch"])
        .withColumn("_until", F.least("_next", F.col("last_idx") + 1))
        .filter("qty > 0 AND idx < _until")
        .select(*BOOK, "epoch", "price", "qty", F.explode(F.sequence(F.col("idx") + 1, F.col("_until"))).alias("idx"))
    )
    qty_text = F.format_string("%d.%02d", F.expr("qty div 100"), F.col("qty") % 100)
    # a book has as many levels as there are ticks
    books = spans.groupBy(*BOOK, "epoch", "idx").agg(
        F.to_json(F.collect_list(F.array("price", qty_text))).alias("levels")
    )
    opened = slices.filter("opening_epoch IS NOT NULL").select(
        *BOOK, "slice", "idx", F.col("opening_epoch").alias("epoch")
    )
    return opened.join(books, [*BOOK, "epoch", "idx"], "left").select(
        *BOOK, "slice", F.coalesce("levels", F.lit("[]")).alias("levels")
    )


def hundredths(text: str) -> int:
    return round(float(text) * 100)


def level_text(price: str, qty: int) -> str:
    return json.dumps([price, f"{qty // 100}.{qty % 100:02d}"])


def book_text(book: dict[str, int]) -> str:
    """Levels by rising price, quantities with two decimals."""
    return Side(book).text()


def apply_update(book: dict[str, int], levels: str | None, price: str | None, delta: int | None) -> dict[str, int]:
    """The side after one update; ``levels`` is set for snapshots."""
    if levels is not None:
        listed = {p: hundredths(q) for p, q in json.loads(levels)}  # the last listing of a price
        return {p: q for p, q in listed.items() if q > 0}
    left = book.get(price, 0) + delta
    if left > 0:
        book[price] = left
    else:
        book.pop(price, None)
    return book


class Side:
    """A book side whose levels stay in order with their texts, so that an update
    touches its own level only."""

    def __init__(self, book: dict[str, int]):
        self.book = book
        self._list()

    def _list(self) -> None:
        self.order = sorted((float(p), p) for p in self.book)
        self.texts = {p: level_text(p, q) for p, q in self.book.items()}

    def apply(self, levels: str | None, price: str | None, delta: int | None) -> None:
        had = price in self.book
        self.book = apply_update(self.book, levels, price, delta)
        if levels is not None:
            self._list()
        elif price in self.book:
            self.texts[price] = level_text(price, self.book[price])
            if not had:
                insort(self.order, (float(price), price))
        elif had:
            del self.texts[price]
            del self.order[bisect_left(self.order, (float(price), price))]

    def text(self) -> str:
        return "[" + ", ".join([self.texts[p] for _, p in self.order]) + "]"


def _replay_rows(keep: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of whole (book side, slice) groups in order: one side is held at a
        time and dropped when the next group begins."""
        group, side_now = None, Side({})
        for pdf in batches:
            texts = []
            for market, side, cut, ts, levels, price, delta in zip(
                pdf["market_id"], pdf["side"], pdf["slice"], pdf["source_ts"], pdf["levels"], pdf["price"], pdf["delta"]
            ):
                if (market, side, cut) != group:
                    group, side_now = (market, side, cut), Side({})
                side_now.apply(levels, price, None if levels is not None else int(delta))
                texts.append(None if pd.isna(ts) else side_now.text())
            # the opening book itself is not an update
            out = pdf[["market_id", "side", "source_ts", "seq", *keep]].assign(book_json=texts)
            yield out[pdf["source_ts"].notna()]

    return rows


def replay(
    updates: DataFrame, slice_seconds: float = DEFAULT_SLICE_SECONDS, keep: Sequence[str] = ()
) -> DataFrame:
    """The whole book side after every applied update, with the update's ``keep``
    columns (receive time, platform, the time as text, …), so that the rows are
    stored snapshots as ``operators.books.quotes`` reads them.

    Every slice that has updates lists its opening book, levels times slices in
    all: the price of slices that replay independently. ``slice_seconds`` should
    hold a busy book's slice to a few hundred thousand updates."""
    applied = materialize(with_epoch(materialize(updates), slice_seconds))
    openings = opening_books(applied, level_states(applied, slice_seconds), slice_seconds)
    messages = applied.select(
        *BOOK,
        time_slice("source_ts", slice_seconds).alias("slice"),
        *ORDER,
        F.when(F.col("is_snapshot"), F.col("levels")).alias("levels"),
        "price",
        (F.col("delta") * 100).cast("double").alias("delta"),
        *keep,
    )
    rows = union(messages, openings, missing=True)
    # NULLs sort first, so a slice begins with its opening book
    ordered = rows.repartition(*BOOK, "slice").sortWithinPartitions(*BOOK, "slice", *ORDER)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in applied.select(*keep).schema.fields] if keep else []
    return ordered.mapInPandas(_replay_rows(list(keep)), ", ".join([REPLAY_SCHEMA, *kept]))
