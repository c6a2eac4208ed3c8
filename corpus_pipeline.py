"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a
DataFrame; all but the last return the columns of documents. Stages are written as Parquet and read
again, so each is computed once and is kept when executors are lost. Null and empty texts, repeated
rows and empty tables have the results that the operators in tessera/llm define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, mixing, simhash, toxicity
from tessera.llm.common import delete, scratch_path, table
from tessera.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is 0.5 or more go; the model is learned as in op1."""
    ship(spark)
    model = toxicity.fit(docs.filter(~toxicity.held_out()), table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the longest row stays, then that of the smallest id; a null text counts as empty."""
    ship(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the smallest id."""
    ship(spark)
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row: doc_id, n_tokens and the digests of its ids and of the decoded text."""
    ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("mixing", mix), ("bpe", encode)]

#: SQL has neither the learned scores of the first stage nor the merges of the last; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one's is written; the last stays, as the result reads it."""
    docs, old = table(ship(spark), sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old:
            delete(spark, old)
        old = path
    return docs
