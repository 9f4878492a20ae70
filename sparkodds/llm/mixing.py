"""Mixing sources to target weights by hash thresholds.

Every document has a point on a line: the hash of its id. A source that must
give ``target`` words out of ``source_size`` gives each document
``floor(target / source_size)`` times, and once more those up to a threshold on
that line. The threshold is found from histograms: words by source and hash
bucket, then again only within the bucket where the budget ends, four times.
Documents are never sorted, and no task sees more of a source than its buckets.

Defined results: null text has no words; documents without words are taken 0
words; sources are ordered by code point, null last; rows that repeat an id are
taken or left together; an empty table gives no rows. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkodds.llm.common import n_words, read
from sparkodds.session import materialize

#: Hexadecimal digits that each histogram resolves, and histograms.
DIGITS, LEVELS = 3, 4


def point(doc_id: Column) -> Column:
    """Where a document lies on the line, as hexadecimal digits."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, DIGITS * LEVELS)


def targets(totals: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size) with the words that each source has to give.

    The weights repeat along the ordered sources. Sources are capped in the
    order in which a rising water level would meet their caps; ``rest`` and
    ``open_weight`` are what is left for a source and those after it. The
    windows see one row for each source.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    named = totals.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    named = named.withColumn("weight", w).withColumn("cap", F.col("source_size") * cap)
    scale = 1
    for x in weights:
        scale *= x
    before = Window.orderBy(F.col("cap") * (F.lit(scale) / F.col("weight")).cast("long"), "nth").rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy()
    level = (
        named.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("open_weight") <= F.col("weight") * F.col("rest"))
    )
    first_open = F.max(F.when(~F.col("capped"), F.col("rest"))).over(everything)
    weight_open = F.max(F.when(~F.col("capped"), F.col("open_weight"))).over(everything)
    return level.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * (first_open.cast("double") / weight_open.cast("double")))
        .alias("target"),
    )


def thresholds(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row for each source: source_size, target, whole copies, and the last
    point (``edge``) with whether it is still taken (``edge_in``).

    ``sized`` has source, size and point."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = targets(totals, weights, cap).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    )
    found = found.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    found = materialize(found.withColumn("edge", F.lit("")).withColumn("edge_in", F.lit(False)))
    for level in range(1, LEVELS + 1):
        digits = DIGITS * level
        sums = (
            sized.withColumnRenamed("source", "of")
            .join(
                found.select("source", "edge"),
                F.col("of").eqNullSafe(F.col("source"))
                & (F.substring("point", 1, digits - DIGITS) == F.col("edge")),
            )
            .groupBy("of", F.substring("point", 1, digits).alias("bucket"))
            .agg(F.sum("size").alias("words"))
        )
        up_to = Window.partitionBy("of").orderBy("bucket")
        sums = sums.withColumn("through", F.sum("words").over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
        last = (
            sums.join(found, F.col("of").eqNullSafe(F.col("source")))
            .where(F.col("through") > F.col("budget"))
            .groupBy("of")
            .agg(F.min(F.struct("bucket", "words", "through")).alias("b"))
        )
        over, short = F.col("b.through") - F.col("budget"), F.col("budget") - F.col("b.through") + F.col("b.words")
        found = materialize(
            found.join(last, F.col("of").eqNullSafe(F.col("source")), "left").select(
                "source",
                "source_size",
                "target",
                "whole",
                F.coalesce(short, F.col("budget")).alias("budget"),
                # No bucket passes the budget: every point is taken.
                F.coalesce(F.col("b.bucket"), F.col("edge"), F.lit("")).alias("edge"),
                F.coalesce(over < short, F.lit(False)).alias("edge_in"),
            )
        )
    return found


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), point(F.col("doc_id")).alias("point"))


def copies() -> Column:
    """How often a row of ``thresholds`` joined to a document takes it."""
    inside = (F.col("point") < F.col("edge")) | ((F.col("point") == F.col("edge")) & F.col("edge_in"))
    return F.when(F.col("source_size") > 0, F.col("whole") + inside.cast("long")).otherwise(F.lit(1))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    sized = materialize(sizes(docs))
    found = thresholds(sized, weights, cap).withColumnRenamed("source", "of")
    return sized.join(found, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies().alias("copies"),
        (F.col("size") * copies()).alias("taken"),
    )


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: the documents' rows, each as often as it is taken."""
    found = thresholds(materialize(sizes(docs).select("source", "size", "point")), weights, cap)
    rows = docs.select(F.struct("*").alias("row"))
    placed = rows.withColumn("point", point(F.col("row.doc_id")))
    return (
        placed.join(found, F.col("row.source").eqNullSafe(F.col("source")))
        .withColumn("times", F.sequence(F.lit(1), F.lit(cap)))
        .select("row", F.explode(F.slice("times", F.lit(1), copies().cast("int"))).alias("time"))
        .select("row.*")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, ''))[1:12] AS point
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth
  FROM sized GROUP BY source),
weighed AS (SELECT *, (nth - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sums),
filled AS (
  SELECT a.source, a.source_size, a.weight, a.cap,
         (SELECT sum(source_size) FROM weighed) - coalesce(sum(b.cap), 0) AS rest,
         (SELECT sum(weight) FROM weighed) - coalesce(sum(b.weight), 0) AS open_weight
  FROM weighed a LEFT JOIN weighed b
    ON (b.cap * (6 // b.weight) < a.cap * (6 // a.weight)
        OR (b.cap * (6 // b.weight) = a.cap * (6 // a.weight) AND b.nth < a.nth))
  GROUP BY a.source, a.source_size, a.weight, a.cap, a.nth),
level AS (
  SELECT max(rest)::DOUBLE / max(open_weight)::DOUBLE AS height FROM filled
  WHERE cap * open_weight > weight * rest),
goal AS (
  SELECT source, source_size,
         CASE WHEN cap * open_weight <= weight * rest THEN cap::DOUBLE
              ELSE weight * (SELECT height FROM level) END AS target
  FROM filled),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goal),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.point) AS through,
         sum(s.size) OVER (PARTITION BY s.source, s.point) AS peers
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN through <= budget
                               OR (through - peers <= budget
                                   AND through - budget < budget - (through - peers)) THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM run
"""
