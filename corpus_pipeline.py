"""A corpus pipeline of five training-data operators, each stage a function (spark, docs, sf_dir) -> DataFrame.

quality rules -> near-duplicate removal -> benchmark decontamination -> mixing to target weights -> sharding. Every
stage but the last returns the columns of documents; run() writes each result as Parquet and reads it back as the
next stage's documents.

Columns beside doc_id, text, lang, source and n_chars go through all stages as they are, whatever their names; rows are told
apart by all of their columns, so a null or repeated doc_id is no key. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelmill.llm import decontamination, mixing, near_dedup, quality, sharding
from babelmill.llm.common import row_key, stored, table, whole_row

N_SHARDS, SHINGLE = 24, 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects.

    Null, blank and short texts fail the base rule and go. Rows are judged one by one, so repeated rows stay or go together; labels of
    a null doc_id or quality aren't learned from. Equal gains of two conditions go to the first feature and cut. A very long
    text is measured whole.
    """
    labels = table(spark, sf_dir, "labels")
    rules = quality.learned(docs, labels)
    return quality.accepted(docs, rules)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words.

    Texts without a word are linked with nothing and stay. Of a group the row of the least doc_id stays, of these the one of the
    least row key, of rows repeated in all columns one; a null doc_id comes last. A very long text is described whole.
    """
    return near_dedup.deduplicated(docs, SHINGLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item.

    Texts without a word are clean. Repeated rows go or stay together, also those of one doc_id with different texts each by its
    own. An empty benchmark leaves every document; a very long text is indexed whole.
    """
    held = docs.select(row_key(docs).alias("key"), "text", whole_row(docs).alias("row"))
    found = decontamination.judge(held.select(F.col("key").alias("row_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("row_id").alias("key")).distinct()
    return near_dedup.without_keys(held.drop("text"), gone).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, partial takes cut to their words.

    Texts without a word have no size and are never taken. A null source is a source, the last one. Ties between quotients go
    to the first source, ties in seeded order to the smaller row key; repeated rows are drawn as rows of their own. A very long
    text is many blocks, and may be taken in part.
    """
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot.

    Null and blank texts are rows like others. Rows repeated in all columns get places of their own; there are no ties, as the
    permutation gives each row number one place. A very long text is one row. Columns named shard or slot are replaced.
    """
    return sharding.shard_rows(docs, N_SHARDS)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The learned rules, seeded hash orders and the permutation have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
