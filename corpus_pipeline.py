"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing to target weights, packing.

Each stage takes what the one before it kept, written as Parquet and read again. All but the last return the columns of
documents; the mix returns a row as often as it takes it. All stages bear nulls in any column, empty and very long texts, ties,
repeated rows, empty tables, and extra columns of any name, which they hand on with their values.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attest.llm import exact_dedup, mixing, near_dedup, packing, quality
from attest.llm.common import Scratch, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the latest policy keeps. Null and empty texts have too few words and go; repeated rows are judged alike; an empty table stays empty."""
    return quality.quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least doc_id (as often as it is repeated); rows without a doc_id only if their whole group has none."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at 0.8 the row with the least doc_id of the component; texts without words, and what is linked with nothing, stay."""
    return near_dedup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: none of texts without words; null is a source of its own; reruns agree."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2048 tokens. A null text is its end id alone; a row that comes several times is packed as often; of other columns only doc_id and text are read."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: No SQL: packing and MinHash are not expressible; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that STAGES make of documents. What a stage wrote for itself is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/attest-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with Scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
