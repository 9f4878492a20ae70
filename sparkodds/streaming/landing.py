"""Streaming sources and sinks: landed message files in, keyed tables out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from sparkodds.functions.timefn import from_micros
from sparkodds.operators.latest import keep_last
from sparkodds.sources.landing import CORRUPT
from sparkodds.sources.sinks import upsert_table


def read_messages(spark: SparkSession, path: str, ddl: str, max_files: int = 1000) -> DataFrame:
    """Landed JSON-lines messages as a stream, with the receive time. A broken line
    keeps its text in ``_corrupt_record``, see ``sources.landing.unreadable``.
    ``max_files`` bounds a micro-batch; files beyond it wait for the next."""
    return (
        spark.readStream.schema(f"{ddl}, {CORRUPT} string")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", max_files)
        .json(path)
        .withColumn("recv_ts", from_micros(F.unix_micros(F.current_timestamp())))
    )


def append_table(
    stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), once: bool = True
) -> StreamingQuery:
    """Append a stream to a parquet table, exactly once per checkpoint."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def upsert_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    partition_by: Sequence[str] = (),
    check_moves: bool = True,
) -> StreamingQuery:
    """Keyed upsert per micro-batch. A batch that is run again gives the same
    table, so a restart after a failure is safe."""

    def write(batch: DataFrame, _: int) -> None:
        upsert_table(keep_last(batch, keys, order), path, keys, partition_by, check_moves=check_moves)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class LifecycleLog(StreamingQueryListener):
    """Collects start, error and stop of streaming queries as rows for
    ``collection_metadata``, in UTC. A restart shows as another start, which is
    what the blackout windows need. The list holds a few rows per query run."""

    def __init__(self, platform: str):
        self.platform = platform
        self.rows: list[tuple[str, str, datetime, str | None]] = []

    def _add(self, event: str, details: str | None) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.rows.append((event, self.platform, now, details))

    def onQueryStarted(self, event) -> None:
        self._add("start", str(event.id))

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add("error" if event.exception else "stop", event.exception)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rows so far, to append to the metadata table. Use them with
        ``blackout_centers(..., zone="UTC")``."""
        ddl = "event string, platform string, timestamp timestamp_ntz, details string"
        return spark.createDataFrame(list(self.rows), ddl)
