"""What the operators share: words, chunks of long columns, packed rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def long_texts(spark: SparkSession) -> SparkSession:
    """For jobs that hand texts to Python: batches of fewer rows, since a batch is
    held in memory several times over. A session setting, so jobs call this, not
    operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2500")
    return spark


def give_back() -> None:
    """In a Python worker: give freed memory back to the system. Workers live on
    from stage to stage, and the C library keeps what they have freed, so that a
    stage would pay for the ones before it. Does nothing where there is no such call."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a named query."""
    return long_texts(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(
    docs: DataFrame, keep: list[Column | str], **more: Column
) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """Rows for pandas: ``keep`` columns under numbers, so that they clash with
    nothing, and more columns. Longs travel as text, since pandas makes floats of
    those with nulls. Also their part of a schema, and how to give a result with
    them (and new columns after them) its names and types back."""
    kept = docs.select(*keep).schema.fields
    rows = docs.select(*keep, *more.values()).toDF(*(f"__{i}" for i in range(len(kept))), *more)
    long = [f.dataType == T.LongType() for f in kept]
    rows = rows.withColumns({f"__{i}": F.col(f"__{i}").cast("string") for i, x in enumerate(long) if x})
    schema = ", ".join(f"__{i} {'string' if x else f.dataType.simpleString()}" for i, (f, x) in enumerate(zip(kept, long, strict=True)))

    def back(result: DataFrame) -> DataFrame:
        old = [F.col(f"__{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(kept)]
        return result.select(*old, *result.columns[len(kept) :])

    return rows, schema, back


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def hashed_sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """About n rows, those whose key has a small hash; all if there are no more.
    Nothing is sorted or shuffled, and the same table gives the same rows."""
    total, range_ = df.count(), 1 << 30
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(29), *key), F.lit(range_)) < n * range_ // total)


def spans(lengths: Sequence[int], limit: int) -> Iterator[slice]:
    """Slices of rows whose lengths sum to the limit, or of one longer row."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))
