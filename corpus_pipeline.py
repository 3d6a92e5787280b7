"""Corpus pipeline: rules, near duplicates, repeated passages, mix, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before
has kept, read again from Parquet.  All but the last return the columns of
``documents``.  The stages' defined results for nulls, ties, repeated rows and
empty tables are those of their operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscope.llm import bpe, mixing, rules, simhash, substring
from riskscope.llm.common import documents, shared_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return rules.keep(docs, rules.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs, shingle=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier somewhere."""
    return substring.without_repeats(docs, window=20)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digest of their decoding."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, offsets=False).drop("text")
    return bpe.decode(ids, path, pattern).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing to target weights", mixed_sources),
    ("byte-level bpe", token_ids),
]

#: SQL has neither isolation forests, XXH64 nor BPE.  tests/llm/test_whole_rows.py holds all rows of run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and
    read again, so that a lost executor costs one stage at most."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
