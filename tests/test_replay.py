"""Replay: hand-made cases, batch against a plain reading, stream against batch."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest

from sparkodds import schemas
from sparkodds.operators import books, connections, replay
from sparkodds.sources import landing
from sparkodds.streaming import books as stream_books
from sparkodds.streaming import landing as stream_landing
from sparkodds.streaming.connections import reconnect_stream

T0 = 1_785_000_000_000


def snapshot(t, yes, no=(), ticker="T"):
    return {"type": "orderbook_snapshot", "msg": {"market_ticker": ticker, "ts_ms": T0 + t, "yes_dollars_fp": list(yes), "no_dollars_fp": list(no)}}


def delta(t, price, qty, side="yes", ticker="T"):
    return {"type": "orderbook_delta", "msg": {"market_ticker": ticker, "ts_ms": T0 + t, "side": side, "price_dollars": price, "delta_fp": qty}}


def updates(spark, messages):
    rows = [(i, json.dumps(m)) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "seq bigint, payload string")
    return landing.book_updates(landing.parse(df, "payload", schemas.BOOK_MESSAGE, ["seq"]), ["seq"])


def run(spark, messages, width=3600.0):
    got = replay.replay(updates(spark, messages), width).collect()
    return {(r.seq, r.market_id, r.side): json.loads(r.book_json) for r in got}


def plain(messages):
    """One book at a time, message by message."""
    sides, out = {}, {}
    order = sorted(range(len(messages)), key=lambda i: (messages[i].get("msg", {}).get("ts_ms", 0), i))
    for i in order:
        m = messages[i].get("msg", {})
        t = m.get("market_ticker")
        if messages[i]["type"] == "orderbook_snapshot":
            for side in ("yes", "no"):
                listed = {p: round(float(q) * 100) for p, q in m[f"{side}_dollars_fp"]}
                sides[t, side] = {p: q for p, q in listed.items() if q > 0}
                out[i, t, side] = dict(sides[t, side])
        elif messages[i]["type"] == "orderbook_delta" and (t, m["side"]) in sides:
            book = sides[t, m["side"]]
            q = book.get(m["price_dollars"], 0) + round(float(m["delta_fp"]) * 100)
            book.pop(m["price_dollars"], None)
            if q > 0:
                book[m["price_dollars"]] = q
            out[i, t, m["side"]] = dict(book)
    return {k: [[p, f"{q // 100}.{q % 100:02d}"] for p, q in sorted(b.items(), key=lambda kv: float(kv[0]))] for k, b in out.items()}


CASES = [
    delta(0, "0.40", "5.00"),  # before any snapshot: ignored
    snapshot(1000, [["0.40", "13.00"], ["0.41", "2.50"]], [["0.55", "7.00"]]),
    delta(2000, "0.41", "-2.50"),  # to zero: gone
    delta(3000, "0.40", "-99.00"),  # below zero: gone
    delta(4000, "0.40", "1.25"),  # from zero again
    delta(5000, "0.09", "3.00"),  # new level, sorts below 0.40
    delta(5500, "0.55", "1.00", side="no"),
    {"type": "subscribed"},
    {"type": "error", "msg": {}},
    snapshot(6000, [["0.30", "1.00"]]),  # replaces both sides
    delta(7000, "0.30", "0.10"),
    delta(8000, "0.60", "4.00", side="no"),
    delta(9000, "0.30", "1.00", ticker="other"),
    snapshot(10000, [["0.41", "5.00"], ["0.41", "7.00"], ["0.42", "3.00"], ["0.42", "0.00"]]),  # listed twice
    delta(14000, "0.41", "1.00"),
]


@pytest.mark.parametrize("width", [0.5, 2.0, 3600.0])
def test_cases(spark, width):
    got = run(spark, CASES, width)
    assert got == plain(CASES)
    assert got[4, "T", "yes"] == [["0.40", "1.25"]]
    assert got[5, "T", "yes"] == [["0.09", "3.00"], ["0.40", "1.25"]]
    assert got[9, "T", "no"] == [] and got[11, "T", "no"] == [["0.60", "4.00"]]
    assert all(k[1] == "T" for k in got)


def random_messages(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ticker = "hot" if rng.random() < 0.4 else f"t{rng.randrange(5)}"
        t = i * 37 + rng.randrange(30)
        if rng.random() < 0.06:
            out.append(snapshot(t, [[f"0.{rng.randrange(40, 60)}", f"{rng.randrange(1, 50)}.50"]], [["0.30", "9.00"]], ticker))
        else:
            out.append(delta(t, f"0.{rng.randrange(40, 46)}", f"{rng.randrange(-40, 40)}.25", rng.choice(["yes", "no"]), ticker))
    return out


@pytest.mark.parametrize("seed, width", [(1, 1.0), (2, 4.0), (3, 100.0)])
def test_random(spark, seed, width):
    messages = random_messages(seed)
    assert run(spark, messages, width) == plain(messages)


def feed(spark, tmp_path, rows, ddl, n_files, seed, *flush):
    """Rows as JSON lines dealt over files at random, one file for each micro-batch,
    and last ones that move the watermark on."""
    source = tmp_path / f"in{n_files}"
    source.mkdir()
    rng = random.Random(seed)
    files = [[] for _ in range(n_files)]
    for row in rows:
        files[rng.randrange(n_files)].append(row)
    for f, part in enumerate([*files, *([f] for f in flush)]):
        rng.shuffle(part)
        (source / f"{f:03d}.json").write_text("\n".join(json.dumps(r) for r in part))
        os.utime(source / f"{f:03d}.json", (1_785_000_000 + f, 1_785_000_000 + f))  # files are read by age
    return stream_landing.read_messages(spark, str(source), ddl, max_files=1)


def written(spark, tmp_path, stream, name):
    out = str(tmp_path / name)
    stream_landing.append_table(stream, out, str(tmp_path / f"{name}-cp")).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("n_files", [1, 3, 20])
def test_stream_equals_batch_however_it_is_cut(spark, tmp_path, n_files):
    messages = random_messages(11, 120)
    flush = dict(delta(10**8, "0.01", "1.00", ticker="none"), seq=-1)
    raw = feed(spark, tmp_path, [dict(m, seq=i) for i, m in enumerate(messages)], f"seq bigint, {schemas.BOOK_MESSAGE}", n_files, n_files, flush)
    updates = landing.book_updates(raw, ["seq", "recv_ts"])
    books_stream = stream_books.replay_stream(updates, "1 hour", ["recv_ts"])
    got = written(spark, tmp_path, books_stream, "books").collect()
    assert {(r.seq, r.market_id, r.side): json.loads(r.book_json) for r in got} == plain(messages)
    assert len(got) == len(plain(messages)) and all(r.recv_ts > datetime(2026, 1, 1) for r in got)
    assert all(r.source_ts.year == 2026 for r in got)


def test_late_updates_are_not_applied(spark, tmp_path):
    first = [dict(snapshot(0, [["0.40", "1.00"]]), seq=0), dict(delta(60_000, "0.40", "1.00"), seq=1)]
    late = [dict(delta(1_000, "0.40", "5.00"), seq=2), dict(delta(61_000, "0.40", "1.00"), seq=3)]
    source = tmp_path / "in"
    source.mkdir()
    tick = [dict(delta(60_500, "0.01", "1.00", ticker="none"), seq=-2)]
    for f, part in enumerate([first, tick, late, [dict(delta(10**8, "0.01", "1.00", ticker="none"), seq=-1)]]):
        (source / f"{f}.json").write_text("\n".join(json.dumps(r) for r in part))
        os.utime(source / f"{f}.json", (1_785_000_000 + f, 1_785_000_000 + f))
    raw = stream_landing.read_messages(spark, str(source), f"seq bigint, {schemas.BOOK_MESSAGE}", max_files=1)
    books_stream = stream_books.replay_stream(landing.book_updates(raw, ["seq"]), "5 seconds").filter("side = 'yes'")
    rows = written(spark, tmp_path, books_stream, "books").orderBy("source_ts").collect()
    assert [(r.seq, json.loads(r.book_json)[0][1]) for r in rows] == [(0, "1.00"), (1, "2.00"), (3, "3.00")]


@pytest.mark.parametrize("n_files", [1, 7])
def test_top_change_stream_equals_batch(spark, tmp_path, n_files):
    rng = random.Random(5)
    rows = [{"game_key": "g", "update_type": rng.choice(["k_bid", "k_ask"]), "timestamp": f"2026-07-30T00:{i // 60:02d}:{i % 60:02d}", "seq": i,
             "price": None if rng.random() < 0.2 else 0.4 + 0.01 * rng.randrange(2), "size": 5.0} for i in range(80)]
    ddl = "game_key string, update_type string, timestamp timestamp_ntz, seq bigint, price double, size double"
    flush = dict(rows[0], game_key="none", timestamp="2026-08-30T00:00:00")
    raw = feed(spark, tmp_path, rows, ddl, n_files, 1, flush)
    got = written(spark, tmp_path, stream_books.top_changes_stream(raw, "1 hour"), "changes")
    df = spark.createDataFrame([(*(r[c] for c in ("game_key", "update_type")), datetime.fromisoformat(r["timestamp"]), r["seq"], r["price"], r["size"]) for r in rows], ddl)
    batch = books.bbo_changes(df.selectExpr("*", "timestamp AS recv_ts", "seq AS id"), slice_seconds=7.0)
    assert sorted(r.seq for r in got.collect()) == sorted(r.id for r in batch.collect())


def numbered_messages():
    """Platform a misses numbers, starts again, falls silent and repeats a message; b goes on."""
    a = [(0, 1), (1, 2), (2, 3), (3, 6), (4, 7), (4, 7), (5, 1), (6, 2), (60, 3), (61, 4)]
    b = [(t, t + 1) for t in range(0, 90)]
    rows = [("a", t, n) for t, n in a] + [("b", t, n) for t, n in b]
    return [{"platform": p, "source_ts": f"2026-07-30T00:{t // 60:02d}:{t % 60:02d}", "seq": n} for p, t, n in rows]


WANT = [
    ("start", "a", 0, "first message"),
    ("reconnect", "a", 3, "2 messages missing after 3"),
    ("reconnect", "a", 5, "numbered from 1 again after 7"),
    ("reconnect", "a", 60, "silent for 54000 ms"),
    ("start", "b", 0, "first message"),
]


@pytest.mark.parametrize("width", [2.0, 3600.0])
def test_reconnects(spark, width):
    ddl = "platform string, source_ts timestamp_ntz, seq bigint"
    rows = [(r["platform"], datetime.fromisoformat(r["source_ts"]), r["seq"]) for r in numbered_messages()]
    df = spark.createDataFrame([*rows, ("a", None, 99), ("a", rows[0][1], None)], ddl)
    got = connections.reconnects(df, slice_seconds=width).orderBy("platform", "timestamp").collect()
    start = datetime(2026, 7, 30)
    assert [tuple(r) for r in got] == [(e, p, start + timedelta(seconds=t), d) for e, p, t, d in WANT]
    assert connections.reconnects(df.limit(0)).count() == 0


@pytest.mark.parametrize("n_files", [1, 5])
def test_reconnect_stream_equals_batch(spark, tmp_path, n_files):
    ddl = "platform string, source_ts timestamp_ntz, seq bigint"
    flush = [{"platform": "c", "source_ts": f"2026-08-3{d}T00:00:00", "seq": d + 1} for d in range(2)]
    raw = feed(spark, tmp_path, numbered_messages(), ddl, n_files, 3, *flush)
    found = written(spark, tmp_path, reconnect_stream(raw, delay="1 hour"), "events").filter("platform != 'c'")
    rows = found.orderBy("platform", "timestamp").collect()
    start = datetime(2026, 7, 30)
    assert [tuple(r) for r in rows if r.event != "silence"] == [(e, p, start + timedelta(seconds=t), d) for e, p, t, d in WANT]
    silent = [(r.platform, r.timestamp, r.details) for r in rows if r.event == "silence"]
    assert silent == [("a", start + timedelta(seconds=36), "nothing after 2"), ("a", start + timedelta(seconds=91), "nothing after 4"), ("b", start + timedelta(seconds=119), "nothing after 90")]
