"""A corpus pipeline from the numbered operators: quality rules, exact and near
deduplication, repeated passages, packing.

Each stage works on all that the one before it kept. ``run`` writes every
stage but the last as Parquet in the cluster's shared folder and reads it
again, so a lost executor never repeats more than a stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import shared_folder
from pointloom.llm.exact_dedup import drop_exact_duplicates
from pointloom.llm.line_dedup import remove_repeated_lines
from pointloom.llm.packing import pieces_of
from pointloom.llm.quality_rules import keep_quality
from pointloom.llm.simhash_dedup import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, without their repeated passages; n_chars follows the text."""
    cut = remove_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(cut.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces_of(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near dedup", near), ("substring dedup", passages), ("packing", packing)]

#: Neither compression, XXH64 nor tokens can be had in SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """A stage's files go when the next stage's are complete."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
