"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. `run` applies them to `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.llm import decontaminate, mixing, neardup, quality, sharding
from stemloom.llm import text as T


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep; the bands come from labelled rows of the whole table.

    Null and empty texts have under 50 words and go; a null language is one language; repeated rows are
    judged alike, each; an empty table gives an empty result; all columns stay, whatever their names.
    """
    judged = quality.judge(docs, T.table(spark, sf_dir, "labels"), fit_docs=T.documents(spark, sf_dir))
    return T.unpacked(judged.filter("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id.

    Null and empty texts are one class; a null doc_id stays only where its class has no other; repeated
    rows stay once, and of rows that differ only in other columns the one with the least hash stays; an
    empty table gives an empty result; all columns stay.
    """
    return neardup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item.

    Null and empty texts overlap with nothing and stay; null items are skipped; repeated rows stay or go
    together; an empty table, or an empty benchmark, is no special case; all columns stay.
    """
    return decontaminate.clean(docs, T.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as the systematic sample emits it.

    Null and empty texts have no words and are emitted like others; a null source is one source, the
    last; repeated rows are ordered by a hash of all columns and decided each; an empty table gives an
    empty mix; all columns stay.
    """
    return mixing.mix(docs)


def uniform_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard and its slot there, two more columns with names that the others don't have.

    Nulls are ordinary values; repeated rows get a slot each; an empty table gives an empty result.
    """
    x = sharding.shard(docs, [F.col("`doc_id`"), F.xxhash64(F.col("`text`"))])
    shard, slot = T.fresh(docs, "shard"), T.fresh(docs, "slot")
    return T.unpacked(x, docs.columns, [F.col("shard").alias(shard), F.col("slot").alias(slot)])


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
    ("sharding", uniform_sharding),
]

#: The rules of the tokeniser and the pruning of pairs have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages after one another; a stage's rows are removed when the next one's are written."""
    docs, folder = T.documents(spark, sf_dir), T.shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            T.removed(spark, f"{folder}/{k - 1}")
    return docs
