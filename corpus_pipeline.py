"""A training corpus from `documents`: good documents, none toxic, one of each group of near copies, mixed and packed.

Every stage works on what its predecessor kept and returns the columns of `documents`; the last returns packed pieces.
Driver and executors serve all stages: each begins by giving back the memory that those before it have left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import minhash, mixing, packing, quality, toxicity
from palimpsest.llm.common import give_back, id_crc, save, table

#: Chunks that packing remembers here: its workers have served the stages before and hold more than those of op3_packing.
CHUNKS = 400_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the line model calls good."""
    give_back(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"), id_crc("doc_id", 3) == 1)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that, deobfuscated, aren't called toxic."""
    give_back(spark)
    return toxicity.keep(docs, table(spark, sf_dir, "labels"), id_crc("doc_id", 5) == 0)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    give_back(spark)
    return minhash.keep_one(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    give_back(spark)
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; a document that is taken twice is packed twice."""
    give_back(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), most=CHUNKS)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", one_of_each), ("mixing", to_weights), ("packing", packed)]

#: The classifiers, sketches and tokens of the stages have no SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
