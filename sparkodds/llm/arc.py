"""Legacy ARC archives and their conversion to WARC.

An ARC file is a version block and then records: one header line, whose fields
the version block's version fixes, and as many bytes as its last field says.
``arc_records`` reads such files, ``warc_rows`` makes the WARC records that say
the same (identifiers, dates, types and digests are derived from the legacy
record alone, so a second conversion gives the same bytes), ``write_warc``
stores them and ``read_warc`` reads WARC files back by their declared lengths.

Archives are written by Spark's text sink, one row for each record with the
record's end as line separator, in compressed files of a bounded number of
records; they are read as binary files, so any store that Spark reaches will do
and a file is what one step holds in memory.

Defined results: null html is an empty payload; a null url is stored as
``about:blank`` and white space in urls percent-encoded; a null page_id stays
null and comes last among equal payloads; rows that repeat the smallest page_id
are all responses. A broken ARC header line or a record cut short gives a row
with ``error`` instead of ending the job, and reading goes on at the next header
line. Other columns of pages aren't read, so they may have any name.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkodds.llm.common import read
from sparkodds.session import materialize, shared_folder

#: Fixed values of the formats: names of the header fields by ARC version, profile of a revisit.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records of one file, and the least payload that a revisit is worth.
FILE_RECORDS, REVISIT_BYTES = 2000, 100

#: Archive date of pages, which carry none.
NO_DATE = "19700101000000"

LEGACY = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("head", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

WARC = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)


# -- legacy archives ---------------------------------------------------------


def version_block(version: int, name: str) -> str:
    """The block that opens an ARC file, without the line end that closes it."""
    body = f"{version} 0 {name}\n{ARC_FIELDS[version]}\n"
    own = [f"filedesc://{name}", "0.0.0.0", NO_DATE, "text/plain"]
    own += ["200", "-", "-", "0", name] if version == 2 else []
    return f"{' '.join(own)} {len(body.encode())}\n{body}"


def arc_record(version: int, url: str | None, page_id: int | str | None, html: str | None) -> str:
    """One page as an ARC record of an HTTP response, without the closing line end."""
    body = html or ""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"{head}Content-Length: {len(body.encode())}\r\n\r\n{body}"
    target = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
    own = [target, "0.0.0.0", NO_DATE, "text/html"]
    own += ["200", "-", "-", "0", "-"] if version == 2 else []
    return f"{' '.join(own)} {len(block.encode())}\n{block}"


def write_arc(pages: DataFrame, path: str) -> None:
    """Pages as gzipped ARC files of both versions, by turns of the partitions."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nth = TaskContext.get().partitionId()
        version, written = 1 + nth % 2, 0
        for part in parts:
            out = []
            for page_id, url, html in zip(part["page_id"], part["url"], part["html"], strict=True):
                if written % FILE_RECORDS == 0:
                    out.append(version_block(version, f"pages-{nth}-{written // FILE_RECORDS}.arc"))
                out.append(arc_record(version, url, page_id, html))
                written += 1
            yield pd.DataFrame({"value": out})

    (
        pages.select(F.col("page_id").cast("long").cast("string"), "url", "html")
        .mapInPandas(rows, "value string")
        .write.option("lineSep", "\n")
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", FILE_RECORDS + 1)
        .text(path)
    )


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def arc_header(line: bytes, version: int) -> tuple[list[str], int]:
    """The fields of a header line and the declared length. Fields are taken from
    the right, since old crawlers left spaces in urls."""
    fields = line.decode("utf-8", "replace").rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
    if len(fields) < len(ARC_FIELDS[version].split()) or not re.fullmatch(r"\d{14}", fields[2]):
        raise ValueError("no ARC header line")
    return fields, int(fields[-1])


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of one ARC file, the version block left out."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        start, line = at, data[at:end].rstrip(b"\r")
        row = dict.fromkeys(LEGACY.names) | {"offset": start, "version": version}
        try:
            if line.startswith(b"filedesc:"):
                length = int(line.rsplit(b" ", 1)[1])
                version = int(data[end + 1 : end + 2])
                if version not in ARC_FIELDS:
                    raise ValueError(f"ARC version {version}")
                at = end + 1 + length
                continue
            fields, length = arc_header(line, version)
        except (ValueError, IndexError) as e:
            version = version if version in ARC_FIELDS else 1
            at = end + 1
            yield row | {"error": f"{type(e).__name__}: {e}"}
            continue
        block = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        row |= {"url": fields[0], "ip": fields[1], "date": fields[2]}
        if len(block) < length:
            yield row | {"error": f"{len(block)} of {length} bytes"}
            continue
        head, cut, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        if block.startswith(b"HTTP/") and not cut:
            head, body = block, b""
        try:
            text, head_text = body.decode("utf-8"), head.decode("utf-8")
        except UnicodeDecodeError as e:
            yield row | {"error": f"payload: {e.reason}"}
            continue
        page = re.search(r"(?im)^X-Page-Id: (-?\d+)\s*$", head_text)
        yield row | {
            "page_id": int(page[1]) if page else None,
            "head": head_text,
            "payload": text,
            "payload_bytes": len(body),
            "payload_digest": hashlib.sha256(body).hexdigest(),
        }


def tables(rows: Iterator[dict], schema: T.StructType, limit: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Rows as frames of a few million characters."""

    def frame(held: list[dict]) -> pd.DataFrame:
        found = {}
        for f in schema.fields:
            kind = "Int64" if isinstance(f.dataType, (T.LongType, T.IntegerType)) else object
            found[f.name] = pd.Series([x[f.name] for x in held], dtype=kind)
        return pd.DataFrame(found)

    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 200 + len(row["payload"] or "")
        if chars >= limit:
            yield frame(held)
            held, chars = [], 0
    if held:
        yield frame(held)


def arc_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the ARC files below a path (columns of LEGACY)."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                left_out = {} if payload else {"payload": None, "head": None}
                yield from tables((x | {"file": name} | left_out for x in parse_arc(unpacked(content))), LEGACY)

    return files(spark, path).mapInPandas(rows, LEGACY)


# -- WARC --------------------------------------------------------------------


def record_id(page_id: int | str | None, url: str, date: str, digest: str) -> str:
    """The identifier that a legacy record gets, the same in every conversion."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{page_id}:{url}:{date}:{digest}')}>"


def warc_record(row: dict) -> str:
    """A WARC record without the two line ends that close it."""
    head, first = row["head"], row["first_id"]
    kind = "revisit" if first is not None else "response" if head else "resource"
    block = f"{head}\r\n\r\n" if head else ""
    block += "" if kind == "revisit" else row["payload"]
    d = row["date"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(row['page_id'], row['url'], d, row['payload_digest'])}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {row['url']}",
        f"WARC-IP-Address: {row['ip']}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block.encode()).hexdigest()}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if kind == "revisit":
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To-Target-URI: {row['first_url']}",
            f"WARC-Refers-To: {record_id(first, row['first_url'], row['first_date'], row['payload_digest'])}",
            f"X-Refers-To-Page: {first}",
        ]
    lines.append("Content-Type: " + ("application/http; msgtype=response" if head else "text/html"))
    return "\r\n".join([*lines, f"Content-Length: {len(block.encode())}"]) + "\r\n\r\n" + block


def repeats(index: DataFrame) -> DataFrame:
    """For each payload that several of the records have: the page_id, url and
    date of the one that is kept. Equal payloads meet as partial minima only."""
    large = index.where(F.col("error").isNull() & (F.col("payload_bytes") >= REVISIT_BYTES))
    first = (
        large.groupBy(F.col("payload_digest").alias("same"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
    )
    return (
        large.join(first, (F.col("payload_digest") == F.col("same")) & (F.col("page_id") == F.col("first_id")))
        .groupBy("same", "first_id")
        .agg(F.min("url").alias("first_url"), F.min("date").alias("first_date"))
    )


def warc_rows(records: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """WARC records, as text, of legacy records without an error. Of equal
    payloads of REVISIT_BYTES and more, the one with the smallest page_id is kept.

    ``index`` may hold the records without payloads. Payloads are shuffled only
    where the table of repeated ones is too large for Spark to broadcast."""
    first = materialize(repeats(records if index is None else index))
    large = (F.col("payload_digest") == F.col("same")) & (F.col("payload_bytes") >= REVISIT_BYTES)
    joined = records.where(F.col("error").isNull()).join(first, large, "left")
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    names = ["url", "ip", "date", "page_id", "head", "payload", "payload_bytes", "payload_digest", "first_id", "first_url", "first_date"]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.astype(object).where(part.notna(), None)
            yield pd.DataFrame({"value": [warc_record(dict(zip(names, r, strict=True))) for r in part[names].itertuples(index=False)]})

    # As text, since pandas makes floats of numbers with nulls.
    texts = {"page_id": F.col("page_id").cast("string"), "first_id": revisits.cast("string")}
    slim = joined.withColumns(texts).withColumn("payload", F.when(F.col("first_id").isNull(), F.col("payload")))
    return slim.select(names).mapInPandas(rows, "value string")


def write_warc(rows: DataFrame, path: str) -> None:
    (
        rows.write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(path)
    )


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of one WARC file, by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        block = data[start : start + int(head["Content-Length"])]
        at = start + len(block) + 4
        http = head["Content-Type"].startswith("application/http")
        body = block.partition(b"\r\n\r\n")[2] if http else block
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Type"] != "revisit" and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"{head['WARC-Record-ID']}: the payload isn't what its digest says")
        yield {
            "record_id": head["WARC-Record-ID"],
            "record_type": head["WARC-Type"],
            "date": head["WARC-Date"],
            "url": head["WARC-Target-URI"],
            "page_id": int(head["X-Page-Id"]) if "X-Page-Id" in head else None,
            "refers_to": int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None,
            "payload_bytes": int(head["X-Payload-Length"]),
            "payload_digest": digest,
            "payload": None if head["WARC-Type"] == "revisit" else body.decode("utf-8"),
        }


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the WARC files below a path (columns of WARC)."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                found = parse_warc(unpacked(content))
                yield from tables(found if payload else (x | {"payload": None} for x in found), WARC)

    return files(spark, path).mapInPandas(rows, WARC)


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> DataFrame:
    """Convert the ARC files below a path; the rejected records, if any."""
    index = materialize(arc_records(spark, arc_path, payload=False).drop("head", "payload"))
    write_warc(warc_rows(arc_records(spark, arc_path), index), warc_path)
    return index.where(F.col("error").isNotNull()).select("file", "offset", "version", "url", "error")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(read(spark, sf_dir, "pages"), f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc", payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100
  GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
