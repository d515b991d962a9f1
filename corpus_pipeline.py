"""A corpus pipeline: quality, near-duplicates, benchmark passages, mixing, shards. Each stage reads what the stage before
wrote as Parquet. Part of the subpackage llm.

An empty table passes every stage as an empty one; other columns pass all but the last stage unchanged, whatever their names; texts are taken
whole. Repeated rows are alike to every stage. Null and empty texts and null ids: see each stage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from anemos.llm._common import shared_folder
from anemos.llm.decontaminate import decontaminate
from anemos.llm.mixing import draw_mix
from anemos.llm.quality import quality_filter
from anemos.llm.sharding import kd_shards
from anemos.llm.simhash import simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, accepts. Null and empty texts are scored like others, by
    a vector of zeros."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id: five-word shingles, Jaccard similarity 0.8. Null and empty
    texts are copies of each other; documents without an id stay."""
    return simhash_dedup(docs, similarity=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null and empty texts hold none; documents without an id go if they hold one."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it. A null source is a source, last in order; texts without words go with their
    block; of a document without an id the text's digest decides."""
    return draw_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot; null texts have one byte, and equal texts share a shard."""
    return kd_shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("mixing", mixed), ("sharding", shards)]

#: SQL expresses neither the classifier nor the alignment; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; in-between results go to the session's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
