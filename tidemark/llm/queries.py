"""The thin ``opN_*`` queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle, suffix_dedup
from .common import documents, labels
from .decontam import search
from .jaccard_join import join
from .langid import identify
from .packing import pack
from .pii import find
from .quality_rules import quality
from .sstable import read_shards, write_shards
from .substring_dedup import dedup
from .tokens import default_tokenizer
from .toxicity import toxicity


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir)).drop("n_added")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), labels(spark, sf_dir)).drop("stratum", "failed_rules")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(documents(spark, sf_dir), default_tokenizer(), end_id=2))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir)).drop("marks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_benchmark_decontamination, op4_ngram_jaccard_join, op5_suffix_dedup, op6_line_dedup, op3_best_fit_packing, op7_language_id, op8_quality_rules, op9_token_output, op10_toxicity)}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": oracle.JACCARD_JOIN,
    "op6_line_dedup": oracle.LINE_DEDUP,
    "op8_quality_rules": oracle.quality_rules(),
}
