"""The training-data operators as queries over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import ship
from . import golay, host_rules, mixing, packing, quality_knn, secrets, sketches, toxicity, transducer, url_filter
from .sql import SQL

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints_of_edits(_table(spark, sf_dir, "documents"))


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(_table(spark, sf_dir, "documents"))


def op6_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_knn, op2_pivotal_mix, op3_bottom_k, op4_pattern_packing, op5_host_rules, op6_classifier_chain, op7_url_vocabulary, op8_entropy_secrets, op9_transducer_counts, op10_golay_simhash)}
ORACLE_SQL: dict[str, str] = SQL
