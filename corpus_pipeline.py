"""From raw documents to packed training windows, as stages that each keep what the next one works on.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Each operator's docstring defines what it does with nulls, empty or very long texts, ties, repeated rows,
empty tables and further columns; stages add nothing to that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from driftquarry.llm import exact_dedup, ngram_join, packing, quality, suffix_dedup
from driftquarry.llm.common import remove_folder, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.drop_near(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus."""
    return suffix_dedup.cut_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in windows."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("ngram_join", near_stage), ("suffix_dedup", passage_stage), ("packing", packing_stage)]

#: SQL can't express the classifier or the packing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What stages return is written to the folder that executors share, and deleted once the next stage is written; only what the last one reads stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        if before:
            remove_folder(spark, f"{where}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
