"""A corpus pipeline: language ID, near-duplicates, secrets, packing.

``STAGES`` lists (name, function).  Each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewarden.llm import langid, packing, secret_scan, simhash
from tidewarden.llm.common import read, remove, shared_folder


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows; those it rejects go."""
    return langid.accepted(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)


STAGES = [("language_id", keep_known_languages), ("near_duplicates", keep_one_of_near_duplicates), ("secrets", mask_secrets), ("packing", pack)]

#: The network and the packing have no SQL form; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; results between stages go to the shared folder.

    A stage's result is removed once the next one is written; that of the last but one
    stays, as the result that is returned reads it.
    """
    docs = read(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            remove(spark, before)
        before = f"{place}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
