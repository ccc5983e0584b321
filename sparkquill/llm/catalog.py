"""Queries over the standard tables, one for each operator of this package, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontaminate, exact_dedup, license_scan, line_dedup, near_dedup, packing, sharding, substring_dedup, token_alignment, token_files, toxicity, url_filter
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # three batches: the second meets a run, the third what both were merged into
    index = substring_dedup.FingerprintIndex(spark, most_runs=1)
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), 3, index)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), 85).drop("key", "first")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_files.write_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return token_files.token_digests(spark, folder)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("key")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # three batches: the second meets a run, both are merged into a run of the next level, which the third meets
    index = line_dedup.LineIndex(spark, fanout=2)
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), 3, index)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align(table(spark, sf_dir, "documents"), *files)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


_ALL = (
    op1_substring_dedup, op2_sharding, op3_near_dedup, op4_toxicity, op5_packing,
    op6_token_files, op7_exact_dedup, op8_url_filter, op9_decontaminate, op10_license_scan,
    op11_line_dedup, op12_token_alignment, op13_conversation_repair,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op3_near_dedup": near_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op10_license_scan": license_scan.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
}
