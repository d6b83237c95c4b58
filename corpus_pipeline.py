"""The corpus pipeline: five operators, each on all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. Stages are written as
Parquet and read again; all but the last return the columns of ``documents``, the last adds
``pass, words, shard, shard_order``, the place of each copy in the mixture. Null texts, null
ids, empty tables and repeated rows go through as each operator's module defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontamination, line_dedup, mixing, near_dedup, quality_rules
from tidegauge.llm.common import prepare, table
from tidegauge.session import staged

#: Words per shingle and least similarity, in percent, of near copies: those of op8's contract.
SHINGLE, SIMILAR = 2, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the n-gram ratio keep."""
    return quality_rules.keep_good(docs, table(prepare(spark), sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated and near-repeated lines; one that loses all of them goes."""
    prepare(spark)
    shortened = line_dedup.dedup_lines(docs)
    left = F.trim(F.coalesce("text", F.lit("")), F.lit(line_dedup._WHITE)) != ""
    kept = shortened.filter(left | (F.col("n_near") + F.col("n_exact") == 0))
    changed = F.when(F.col("n_near") + F.col("n_exact") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.withColumn("n_chars", F.coalesce(changed, F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    prepare(spark)
    return near_dedup.dedup(docs, SHINGLE, SIMILAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.decontaminate(docs, table(prepare(spark), sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources, dealt to shards."""
    prepare(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark),
    ("mixing", mixture),
]

#: The n-gram ratio, MinHash groups and the splitting tree have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
