"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canticle.llm import decontamination, mixing, near_dedup, sharding, toxicity
from canticle.llm.queries import table
from canticle.llm.storage import Scratch


#: Benchmark items of fewer words are common phrases; inside longer documents they are no leak.
LEAST_ITEM_WORDS = 5


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects; it is fitted on the labelled ones among docs."""
    return toxicity.keep_clean(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a similarity of 0.8 or more."""
    return near_dedup.keep_one_of_each(spark, docs, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item of LEAST_ITEM_WORDS or more, or that are a shorter one."""
    return decontamination.keep_unleaked(spark, docs, table(spark, sf_dir, "benchmark"), least=LEAST_ITEM_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(spark, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each row in the committed version of a shard store."""
    return sharding.shard(spark, docs)


STAGES = [
    ("toxicity", clean_toxicity),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the learned stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
