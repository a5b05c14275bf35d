"""Corpus pipeline: quality, toxicity, line dedup, near-duplicates, packing; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, packing, quality, simhash, toxicity
from tidemark.llm.common import scratch_path

STAGES = [
    ("quality", quality.stage),
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", simhash.stage),
    ("packing", packing.stage),
]
#: Learned scores, winnowed hashes and the packing plan aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
