"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, license_scan, mixing, packing, quality, secrets, simhash, url_filter, warc
from .common import stage, table
from .oracles import MIX_SQL, WARC_SQL, license_sql, quality_sql

WINDOW = 4096
#: How often a source may be read at most while the source read least is read once.
MAX_EPOCHS = 2.0


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The texts are read and counted once; all passes of the operator are over the counts.
    counted = stage(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_count(F.col("text")).alias("tokens")), "mixing-counts")
    out = mixing.mix(counted, max_epochs=MAX_EPOCHS, tokens_col="tokens")
    return out.select("doc_id", "source", F.col("mix_tokens").alias("tokens"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_start").alias("start"), F.col("mix_weight").alias("weight"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path(), WINDOW)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learn_and_identify(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_source_mixing, op2_license_scan, op3_best_fit_packing, op4_warc, op5_url_filter, op6_secret_scan, op7_quality_rules, op8_language_id, op9_simhash, op10_exact_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": MIX_SQL,
        "op2_license_scan": license_sql(license_scan.posting_rows(), license_scan.COVERAGE),
        "op4_warc": WARC_SQL,
        "op7_quality_rules": quality_sql(quality.MEASURES, quality.REACH, quality.PRIOR),
        "op10_exact_dedup": exact_dedup.DEDUP_SQL,
    }
