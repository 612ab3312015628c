"""The operators of this subpackage as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_dedup, fim, host_rules, license_scan, ngram_join, suffix_dedup, toxicity, warc
from .best_fit import packed
from .block_dedup import dedup_blocks
from .decontaminate import contaminated
from .ngram_join import linked
from .quality_lm import quality
from .shared import documents
from .suffix_dedup import dedup_suffixes
from .token_files import token_files
from .warc import warc_pages
from .whitening import whiten


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir), k=4, percent=85)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(documents(spark, sf_dir))


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, toxicity.calibrate(spark, index))


def op5_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_blocks(documents(spark, sf_dir))


def op6_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return license_scan.scan(docs, license_scan.fit(docs))


def op11_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(documents(spark, sf_dir)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_join, op2_suffix_dedup, op3_best_fit, op4_toxicity, op5_block_dedup, op6_quality_lm, op7_decontaminate, op8_token_files, op9_host_rules, op10_license_scan, op11_warc_chain, op12_fim, op13_whitening, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": ngram_join.ORACLE, "op2_suffix_dedup": suffix_dedup.ORACLE, "op5_block_dedup": block_dedup.ORACLE, "op9_host_rules": host_rules.ORACLE, "op11_warc_chain": warc.ORACLE, "op12_fim": fim.ORACLE}
