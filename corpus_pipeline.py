"""From documents to shards of a training corpus, in stages that are each written and read again.

All stages take rows as they come: a null or empty text breaks a rule and goes in the first stage, so later ones see none unless
they are run alone, when it is in no group, holds no passage, is not mixed in and weighs 8 bytes. Nulls in other columns stay as
they are; a null source is a source of its own, the last. Rows that repeat an id are judged each by their own text. Very long texts
are read whole. An empty table gives an empty table. Further columns go through unchanged, whatever their names, but for the last stage,
which returns shard and slot. Columns of the names that documents has are needed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftlog.llm import decontaminate, mixing, near_dup, quality_rules, sharding
from weftlog.llm.common import table
from weftlog.session import shared_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go; a null or empty text breaks one."""
    return quality_rules.select_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.85 or more) the smallest doc_id stays, with all rows of that id; texts without words are in no group."""
    return near_dup.keep_one(docs, near_dup.group(docs))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; a null or empty text holds none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until the sources come near their target weights, in the order of the schedule. Documents without words go."""
    return mixing.repeat(docs, mixing.mix(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; repeats of a text, or null texts, share a shard."""
    return sharding.assign(docs)


STAGES = [("quality_rules", good), ("near_dup", distinct), ("decontaminate", unseen), ("mixing", mixed), ("sharding", sharded)]

#: Near copies within a similarity and passages within an edit distance cannot be found by SQL in reasonable time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from `documents`; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
