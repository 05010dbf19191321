"""The corpus pipeline: language, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Null and empty texts go at the first stage; an empty
table goes through as one. The last stage keeps lang, which the first one set.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.llm import exact_dedup, language, simhash
from pricelark.llm.bpe import bpe_encode
from pricelark.llm.common import documents, materialise, table
from pricelark.llm.decontaminate import decontaminate


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and long ones that are like no language, go; lang becomes the prediction."""
    return language.keep_identified(docs, language.learn(docs, F.lit(True)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, ids, n_tokens, and digests of the ids and of the text decoded from them."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"), keep=("lang",))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("bpe_encode_decode", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Profiles, fingerprints and BPE can't be expressed in SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None
