import gzip
import hashlib

import pytest

from sparkodds.llm import arc

SCHEMA = "page_id long, url string, html string, payload string, error string"
LONG = "<p>" + "text of a page " * 100_000


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", "e") for r in rows], SCHEMA)


ROWS = [
    (5, "http://a.example/ with space", "x" * 200),
    (3, "http://b.example/", "x" * 200),
    (9, None, "x" * 200),
    (3, "http://b.example/", "x" * 200),
    (1, "http://c.example/", "short"),
    (2, "http://c.example/", "short"),
    (4, "http://d.example/", None),
    (6, "http://e.example/", ""),
    (7, "http://f.example/\n", "WARC/1.1\r\nContent-Length: 7\r\n\r\n" + "ünïcode\r\n\r\n" * 20),
    (8, "http://g.example/", LONG),
    (2**60 + 1, "http://j.example/", "z" * 150),
    (None, "http://h.example/", "y" * 150),
    (None, "http://i.example/", "x" * 200),
]


def test_round_trip(spark, tmp_path):
    arc.write_arc(pages(spark, ROWS).repartition(3), f"{tmp_path}/arc")
    assert arc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc").count() == 0
    rows = arc.read_warc(spark, f"{tmp_path}/warc").collect()
    assert len(rows) == len(ROWS)
    for page_id, _, html in ROWS:
        body = html or ""
        own = [r for r in rows if r.page_id == page_id and r.payload_digest == hashlib.sha256(body.encode()).hexdigest()]
        assert own and all(r.payload_bytes == len(body.encode()) for r in own)
        revisit = html == "x" * 200 and page_id != 3
        assert all(r.record_type == ("revisit" if revisit else "response") for r in own)
        assert all(r.refers_to == (3 if revisit else None) for r in own)
        assert all(r.payload == (None if revisit else body) for r in own)
    ids = {r.record_id for r in rows if r.page_id == 3}
    assert len(ids) == 1
    urls = {r.url for r in rows}
    assert "about:blank" in urls and "http://a.example/%20with%20space" in urls


def test_conversion_repeats_itself(spark, tmp_path):
    arc.write_arc(pages(spark, ROWS).coalesce(1), f"{tmp_path}/arc")
    for name in ("one", "two"):
        arc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/{name}")
    one, two = (sorted(map(str, arc.read_warc(spark, f"{tmp_path}/{n}").collect())) for n in ("one", "two"))
    assert one == two


def test_empty(spark, tmp_path):
    arc.write_arc(pages(spark, []), f"{tmp_path}/arc")
    arc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert arc.read_warc(spark, f"{tmp_path}/warc").count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_versions(version):
    records = [arc.arc_record(version, f"http://x.example/{i} y", i, "é" * i) for i in range(5)]
    data = "".join(r + "\n" for r in [arc.version_block(version, "f.arc"), *records]).encode()
    found = list(arc.parse_arc(data))
    assert [r["page_id"] for r in found] == list(range(5))
    assert [r["payload"] for r in found] == ["é" * i for i in range(5)]
    assert {r["version"] for r in found} == {version} and all(r["error"] is None for r in found)
    assert arc.unpacked(gzip.compress(data)) == data == arc.unpacked(data)


def test_spaces_in_old_urls_and_plain_records():
    body = b"just text"
    data = arc.version_block(1, "f").encode() + b"\nhttp://x.example/a b c 1.2.3.4 20010203040506 text/plain 9\n" + body + b"\n"
    (row,) = arc.parse_arc(data)
    assert (row["url"], row["date"], row["payload"], row["head"]) == ("http://x.example/a b c", "20010203040506", "just text", "")
    record = arc.warc_record(row | {"first_id": None})
    assert "WARC-Type: resource\r\n" in record and "WARC-Date: 2001-02-03T04:05:06Z\r\n" in record


def test_broken_records_do_not_end_the_job():
    good = arc.arc_record(1, "http://x.example/", 7, "fine").encode()
    data = arc.version_block(1, "f").encode() + b"\nno header at all\n" + good + b"\n"
    data += b"http://y.example/ 1.2.3.4 20010203040506 text/html 5000\ntoo short"
    rows = list(arc.parse_arc(data))
    assert [r["page_id"] for r in rows if r["error"] is None] == [7]
    assert len([r for r in rows if r["error"]]) == 2
