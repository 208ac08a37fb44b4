"""A corpus pipeline over ``documents``: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of documents; each works on what the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, neardup, substring, toxicity
from quarry.llm.queries import rank_file
from quarry.plans.shared import materialize


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the classifier learns from the labelled rows among docs."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates (five words, similarity 0.8)."""
    return neardup.without_near_duplicates(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that an earlier document has; n_chars follows the text."""
    out = substring.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights; a row stands as often as the mix takes it."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256. A small memo and small runs: the stages before have filled the executors' heaps."""
    return bpe.encode(docs, rank_file(), public_tokenizers.PATTERN, digests=True, memo=250_000, part=8)


STAGES = [("toxicity", remove_toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mix_sources), ("bpe", tokenize)]

#: Learnt weights, similarity joins and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
