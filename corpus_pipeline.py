"""The corpus pipeline: language ID, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run``
writes and reads back as the next one's ``docs``; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from isopleth.llm import decontaminate, language_id, packing, simhash
from isopleth.llm._shared import materialize
from isopleth.session import ship_package

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Not SQL: character models, XXH64 components and a tokenizer decide the rows.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their own corpus teaches."""
    ship_package(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are alike by 0.8 or more the
    one with the smallest doc_id."""
    ship_package(spark)
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    ship_package(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
