"""The corpus pipeline: documents through five of the training-data operators, each stage written and read again."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from latticework import tune  # noqa: E402
from latticework.llm.decontaminate import clean  # noqa: E402
from latticework.llm.jaccard import keep_one  # noqa: E402
from latticework.llm.mixing import mix  # noqa: E402
from latticework.llm.quality import assess  # noqa: E402
from latticework.llm.sharding import shard  # noqa: E402
from latticework.session import scratch_path  # noqa: E402

# Documents near copies by five-word shingles at a similarity of 0.8 or more.
WIDTH, SIMILAR = 5, (80, 100)
SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    tune(spark)
    return assess(docs, _table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return keep_one(docs, WIDTH, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return clean(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of up-weighted sources again until the mixture is on target."""
    return mix(docs).select(docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in shards of equal bytes, with each document's shard and slot."""
    return shard(docs, SHARDS)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_copies), ("decontamination", decontamination),
          ("mixing", mixture), ("sharding", shards)]
# Clustering, seeded alignment and scheduling are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written to the shared folder and read back."""
    docs = _table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
