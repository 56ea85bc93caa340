"""Queries of this subpackage by name, and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (class_lm, decontaminate, hard_negatives, jaccard_join, language_id, license_scan, line_dedup, merkle, packing, piece_codec, prefix_trie, token_files,
               url_filter)
from .base import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[build.__name__] = build
        if oracle is not None:
            ORACLES[build.__name__] = oracle
        return build
    return register


@query(line_dedup.ORACLE)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    gone = F.aggregate("deleted_runs", F.lit(0).cast("long"), lambda n, run: n + run["last_line"] - run["first_line"] + 1)
    return deduped.select("doc_id", "text", gone.alias("n_deleted"))


@query()
def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(read_table(spark, sf_dir, "documents"))


@query()
def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(read_table(spark, sf_dir, "documents"))


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents")).drop("spans")


@query()
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, sf_dir)


@query(decontaminate.ORACLE)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("doc", "n_near", "items")


@query()
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "action string, host string, path string")
    return url_filter.judge_pages(read_table(spark, sf_dir, "pages"), rules)


@query()
def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_segments(read_table(spark, sf_dir, "documents")))


@query(jaccard_join.ORACLE)
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


@query()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


@query(hard_negatives.ORACLE)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(read_table(spark, sf_dir, "embeddings"))


@query()
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(read_table(spark, sf_dir, "documents"))


@query(prefix_trie.ORACLE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.regrafted_trie(read_table(spark, sf_dir, "conversations"))
