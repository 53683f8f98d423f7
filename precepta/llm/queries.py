"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precepta.llm import collocations as phrases, decontaminate, mixing, near_dedup, quality_rules as rules
from precepta.llm.collocations import collocations
from precepta.llm.common import table
from precepta.llm.decontaminate import contamination
from precepta.llm.html_extract import extract_pages
from precepta.llm.licenses import license_scan
from precepta.llm.mixing import mixing_rates
from precepta.llm.near_dedup import near_duplicates
from precepta.llm.quality_classifier import classify_quality
from precepta.llm.quality_rules import quality_rules
from precepta.llm.substring_dedup import substring_dedup
from precepta.llm.token_align import aligned_tokens
from precepta.llm.token_counts import section_tokens
from precepta.llm.toxicity import TOXIC, toxicity
from precepta.llm.url_filter import judge_urls


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_bad_text", "p_bad_meta", "p_bad", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~held)
    scored = toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_tokens(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_url_filter,
    op2_source_mixing,
    op3_substring_dedup,
    op4_decontamination,
    op5_quality_rules,
    op6_minhash_near_dedup,
    op7_license_scan,
    op8_quality_classifier,
    op9_token_counts,
    op10_html_extraction,
    op11_toxicity,
    op12_phrase_collocations,
    op13_token_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": mixing.ORACLE_SQL, "op4_decontamination": decontaminate.ORACLE_SQL, "op5_quality_rules": rules.ORACLE_SQL, "op6_minhash_near_dedup": near_dedup.ORACLE_SQL, "op12_phrase_collocations": phrases.ORACLE_SQL}
