"""A training corpus from ``documents``: five stages, each over all its predecessor kept."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainset.llm import op2_exact, op3_minhash, op6_bpe, op8_quality, op10_decontaminate
from gainset.llm.tables import table
from gainset.scratch import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects, toxic documents too."""
    return op8_quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts one row, with the largest doc_id."""
    return op2_exact.kept_documents(docs, one_row=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 0.8 or more of their five-word shingles."""
    return op3_minhash.kept_documents(docs, op3_minhash.Similarity(shingle=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return op10_decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``token_ids``, little-endian unsigned 32-bit integers, ``decoded_sha256``, the digest of what they decode to, and whether that is the text, ``round_trip``."""
    out = op6_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.withColumn("decoded_sha256", F.sha2("decoded", 256)).withColumn("round_trip", same).drop("decoded")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("encode", encode)]

#: The quality stage learns a model and the last encodes, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    *written, (_, last) = STAGES
    return last(spark, reduce(lambda d, s: stored(s[1](spark, d, sf_dir), s[0]), written, docs), sf_dir)
