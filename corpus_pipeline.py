"""Documents through the corpus operators, one stage after the other.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
and read again as the next one's docs. All but the last give the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.llm import jaccard_join, line_dedup, mixing, pieces, tokenise, toxicity
from sparkodds.llm.common import columns, long_texts
from sparkodds.session import materialize


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject."""
    long_texts(spark)
    model, logp = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # Numbered on the way, so that no column can be mistaken for the operator's.
    kept = [c.alias(f"__{nth}") for nth, c in enumerate(columns(docs))]
    scored = toxicity.score(docs, model, logp, kept)
    return scored.where(F.col("score") < toxicity.TOXIC).drop("score").toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line, n_chars brought up to date."""
    length = F.coalesce(F.length("row.text").cast("long"), F.col("row.n_chars").cast("long"))
    return line_dedup.dedup(docs).select(F.col("row").withField("n_chars", length).alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that of the smallest id, rows
    without an id last. Rows are told apart by a number of their own, so an id that
    repeats with another text loses only its copies, and of rows that repeat id and
    text one stays."""
    long_texts(spark)
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("of"), F.struct("*").alias("row")))
    found = jaccard_join.near_duplicates(rows.select(F.col("of").alias("doc_id"), F.col("row.text").alias("text")))
    others = materialize(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("of"), "component_id"))
    grouped = others.union(others.select("component_id", "component_id").distinct())
    grouped = materialize(grouped.join(rows.select("of", F.col("row.doc_id").alias("id")), "of"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "of")
    stays = grouped.groupBy("component_id").agg(F.min(place)["of"].alias("stays"))
    gone = grouped.join(stays, "component_id").where(F.col("of") != F.col("stays")).select("of")
    return rows.join(gone, "of", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its target share; rows repeat as often as they are taken."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``pieces``, a sampled segmentation of the text. A column
    of that name is replaced."""
    long_texts(spark)
    return tokenise.encode(docs, pieces.load(), columns(docs.drop("pieces")))


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("mixing", mix),
    ("pieces", tokens),
]

#: Learned models and sampled segmentations can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nth, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if nth < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
