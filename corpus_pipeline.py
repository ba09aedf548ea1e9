"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, as (spark, docs, sf_dir), and returns
a DataFrame that is written as Parquet and read again for the next one. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontam, mixing, quality, shards, simhash
from palimpsest.llm.common import read, remove_at_exit, shared_dir
from palimpsest.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8 or more) one document stays."""
    return simhash.representatives(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in reading order."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order, permuted inside the ranges of reading time that the mix wrote; one row a sequence."""
    tokenizer = shards.Tokenizer(vocabulary("byte_bpe_multi_50k.tiktoken"))
    return shards.write_shards(docs, tokenizer, shards.shard_folder(spark), window=shards.file_window(docs))


STAGES = [("quality", good_quality), ("near-duplicates", one_of_each), ("decontamination", clean), ("mixing", mix), ("token output", tokens)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result goes through Parquet in the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
