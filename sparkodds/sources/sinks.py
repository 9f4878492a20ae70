"""Writing tables: rebuild, append, keyed upsert, exports.

A rebuilt table is a new folder below ``<path>/_versions`` that nobody has read
before, and counts from the moment Spark commits its write with ``_SUCCESS``.
Nothing is renamed or written over: a reader keeps the version that it began with,
a job that dies leaves a folder that is not looked at, and a view in the catalog
can point to the version (``rebuild(view=...)``). Of two rebuilds the one that
began last counts. Partitions are replaced by Spark's dynamic overwrite, which
stages them, within the version that counts.

Stored columns are those of all files: a column that a later write adds is NULL in
older rows, and a write that lacks a column leaves it in the rows it doesn't touch.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkodds.functions.timefn import from_micros
from sparkodds.operators.latest import delete_insert, keep_last, upsert
from sparkodds.session import materialize

VERSIONS = "_versions"

#: Ids count from this time on (2020-01-01 in ms), so many of them for each ms.
_SINCE, _PER_MS = 1_577_836_800_000, 1 << 24


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, path: str) -> list[str]:
    """The folders of a table's finished versions, the oldest first."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(f"{path}/{VERSIONS}")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(f"{path}/{VERSIONS}"))]
    return [f"{path}/{VERSIONS}/{n}" for n in sorted(names) if fs.exists(at(f"{path}/{VERSIONS}/{n}/_SUCCESS"))]


def current(spark: SparkSession, path: str) -> str | None:
    """The folder that holds a table now: its last version, or the path itself
    where rows are only appended; None if there is no table."""
    done = versions(spark, path)
    if done:
        return done[-1]
    fs, at = _file_system(spark, path)
    plain = fs.exists(at(path)) and any(s.getPath().getName() != VERSIONS for s in fs.listStatus(at(path)))
    return path if plain else None


def exists(spark: SparkSession, path: str) -> bool:
    return current(spark, path) is not None


def table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table as it is now, with the columns of all its files. Later
    writers make new versions, so rows don't change under a reader; partitions
    that an upsert replaces are the exception."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"there is no table at {path}")
    return spark.read.option("mergeSchema", True).parquet(folder)


def stored_table(spark: SparkSession, path: str, like: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """A table with its partition columns in the types of ``like``: inferred ones
    would turn a text 0123 into a number. Columns that both have must agree."""
    types = {f.name: f.dataType for f in like.schema.fields}
    fields = [
        T.StructField(f.name, types.get(f.name, f.dataType) if f.name in partition_by else f.dataType)
        for f in table(spark, path).schema.fields
    ]
    for f in fields:
        if types.get(f.name, f.dataType) != f.dataType:
            raise ValueError(f"{path}: {f.name} is stored as {f.dataType.simpleString()}, not {types[f.name].simpleString()}")
    return spark.read.schema(T.StructType(fields)).parquet(current(spark, path))


def rebuild(df: DataFrame, path: str, partition_by: Sequence[str] = (), view: str | None = None) -> DataFrame:
    """Create or replace a table from a query and read it back; ``view`` is made to
    show the new version in one step of the catalog."""
    spark = df.sparkSession
    folder = f"{path}/{VERSIONS}/{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(folder)
    if view:
        spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.`{folder}`")
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in partition_by), *(df.schema[c] for c in partition_by)])
    return spark.read.schema(schema).parquet(folder)


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete finished versions but the last ``keep``, when no reader or view needs
    them any more, and say how many."""
    fs, at = _file_system(spark, path)
    old = versions(spark, path)[: -max(1, keep)]
    return sum(fs.delete(at(folder), True) for folder in old)


def with_built_at(info: DataFrame) -> DataFrame:
    return info.withColumn("built_at", F.current_timestamp())


_ids_lock, _ids_from = threading.Lock(), 0


def first_id(n: int) -> int:
    """The first of n ids above all that this process has given out. Ids grow with
    the time: an append takes longer than its ids' share of it, so appends that
    begin one after the other never share any, in any process."""
    global _ids_from
    with _ids_lock:
        first = max((time.time_ns() // 1_000_000 - _SINCE) * _PER_MS, _ids_from)
        _ids_from = first + n
        return first


def numbered(df: DataFrame, name: str = "id") -> tuple[DataFrame, int]:
    """The rows with ids in the order of the frame's partitions, without gaps, and
    the first id. One number for each task meets on the driver, no row does."""
    place = F.monotonically_increasing_id()
    rows = materialize(df.withColumns({"_task": F.shiftright(place, 33), "_nth": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    total, starts = 0, []
    for task, n in sorted(rows.groupBy("_task").count().collect()):
        starts.append((task, total))
        total += n
    first = first_id(total + 1)
    starts = df.sparkSession.createDataFrame([(task, first + at) for task, at in starts], "_of bigint, _from bigint")
    ids = rows.join(starts, F.col("_task") == F.col("_of")).withColumn(name, F.col("_from") + F.col("_nth"))
    return ids.drop("_task", "_nth", "_of", "_from"), first


def append(df: DataFrame, path: str, stamp: str = "timestamp", partition_by: Sequence[str] = ()) -> None:
    """Append rows with their ingestion time (naive UTC) and an id above those of
    earlier appends. Stored rows aren't read. Each append is a partition of its
    own, ``load`` = its first id, so that appenders don't share a folder: several
    may write at once, and one that dies leaves nothing that is read."""
    rows, first = numbered(df)
    now = from_micros(F.unix_micros(F.current_timestamp()))
    rows.withColumn(stamp, now).write.partitionBy(*partition_by).parquet(f"{path}/load={first}")


def _in_partitions(stored: DataFrame, incoming: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Stored rows of the partitions that the incoming rows touch.

    Each column's values prune directories; the null-safe join leaves just the
    combinations. Both hold at most one entry for each partition, which the
    driver lists anyway."""
    touched = materialize(incoming.select(*partition_by).distinct())
    for c in partition_by:
        values = [r[0] for r in touched.select(c).distinct().collect()]
        wanted = F.col(c).isin([v for v in values if v is not None])
        stored = stored.where(wanted | F.col(c).isNull() if None in values else wanted)
    same = [F.col(c).eqNullSafe(F.col(f"_touched_{c}")) for c in partition_by]
    return stored.join(touched.toDF(*(f"_touched_{c}" for c in partition_by)), same, "left_semi")


def _write_touched(merged: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace partitions of the version that counts."""
    folder = current(merged.sparkSession, path)
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(folder)
    )


def upsert_table(
    incoming: DataFrame,
    path: str,
    keys: Sequence[str],
    partition_by: Sequence[str] = (),
    order: Sequence[str] = (),
    check_moves: bool = True,
) -> None:
    """Insert-or-replace into a parquet table, rewriting touched partitions only.
    Of incoming rows of one key the last in ``order`` wins; columns of ``order``
    that start with an underscore are not stored.

    A key must stay in its partition; a key that would move is an error, because
    its old row sits in a partition that is not rewritten. The check reads the
    table's key columns; switch it off where the partition is derived from
    something a key fixes, such as a trade's date.
    """
    spark = incoming.sparkSession
    latest = keep_last(incoming, keys, order or keys).drop(*(c for c in order if c.startswith("_")))
    if not exists(spark, path):
        rebuild(latest, path, partition_by)
        return
    latest = materialize(latest)
    stored = stored_table(spark, path, latest, partition_by)
    movable = [c for c in partition_by if c not in keys]
    if movable and check_moves:
        moved = (
            stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in movable])
            .join(latest.select(*keys, *movable), list(keys))
            .filter(" OR ".join(f"NOT (_old_{c} <=> {c})" for c in movable))
        )
        if not moved.isEmpty():
            raise ValueError(f"a key of {path} would move between partitions {list(partition_by)}")
    if not partition_by:
        rebuild(upsert(stored, latest, keys), path)
        return
    # the result reads the files it replaces: write it aside first
    _write_touched(materialize(upsert(_in_partitions(stored, latest, partition_by), latest, keys)), path, partition_by)


def replace_keys(incoming: DataFrame, path: str, key: str, partition_by: Sequence[str] = ()) -> None:
    """Delete the stored rows of the incoming keys, then insert. With partitions,
    whose columns a key must fix, only touched ones are rewritten."""
    spark = incoming.sparkSession
    if not exists(spark, path):
        rebuild(incoming, path, partition_by)
        return
    incoming = materialize(incoming)
    stored = stored_table(spark, path, incoming, partition_by)
    if not partition_by:
        rebuild(delete_insert(stored, incoming, key), path)
        return
    merged = materialize(delete_insert(_in_partitions(stored, incoming, partition_by), incoming, key))
    _write_touched(merged, path, partition_by)


def export_csv(df: DataFrame, path: str) -> None:
    """For people; tables between jobs are parquet."""
    df.write.mode("overwrite").option("header", True).csv(path)
