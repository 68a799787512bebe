"""A training corpus from `documents`: identify languages, drop near copies, mask secrets, mix sources, pack.

Each stage takes the whole output of the one before, written as Parquet in the shared folder and read again, so that
a lost executor costs at most one stage's work; it is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.core import fresh_path, remove
from seqloom.llm import langid, mixing, neardup, packing, secrets

TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't known or accepted go."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return neardup.keep_one(docs, width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, every secret in their texts masked; n_chars follows the text."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 2048."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing and shingle components over four rewritten tables aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, before = f"{sf_dir}/documents.parquet", None
    for _, stage in STAGES:
        docs = stage(spark, spark.read.parquet(path), sf_dir)
        path = fresh_path(spark, "stage")
        docs.write.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return spark.read.parquet(path)
