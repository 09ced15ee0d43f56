"""A corpus from raw documents to packed sequences: toxicity, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written as Parquet and read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.storage import shared_dir, ship
from millrace.llm import mixing, packing, resemblance, secrets, toxicity
from millrace.llm.common import remove
from millrace.llm.queries import tokenizer_path


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier chain rejects. Null and empty texts are judged by the intercepts, rows that
    repeat each by themselves, and an empty table stays empty; without labelled rows nothing is toxic."""
    ship(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates: five-word shingles, Jaccard likeness of 0.8 or more. Texts
    without words are one group, rows of one id are told apart by their texts, and rows without an id stay."""
    ship(spark)
    return resemblance.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every secret found; keeps all documents, null and empty texts as they are."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources meet their target weights; a null source is one, and texts without words
    may come as often as others."""
    return mixing.take(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens; a null text is its end mark alone."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity_filter), ("simhash_dedup", simhash_dedup), ("secret_scan", secret_redaction), ("source_mix", source_mix), ("packing", best_fit_packing)]

#: SQL can't express the classifier chain, the fingerprints' hash or the tokenizer; tests/llm holds the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted once the next has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
