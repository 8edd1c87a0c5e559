"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import table
from gridloom.llm.fingerprint import fingerprint_report
from gridloom.llm.html_extract import extract
from gridloom.llm.linededup import dedup_lines_report
from gridloom.llm.mixing import mix_report
from gridloom.llm.ngram_join import linked
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import pii_report
from gridloom.llm.quality import quality
from gridloom.llm.toxicity import score
from gridloom.llm.warc import warc_report


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines_report(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_report(table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary's place on this machine; executors have it in the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_line_dedup, op3_fingerprints, op4_pii, op5_html_extraction,
        op6_toxicity, op7_packing, op8_warc, op9_ngram_join, op10_mixing,
    )}


def oracle_sql() -> dict[str, str]:
    from gridloom.llm import sql

    return {"op1_quality_rules": sql.QUALITY, "op2_line_dedup": sql.LINE_DEDUP, "op8_warc": sql.WARC, "op9_ngram_join": sql.NGRAM_JOIN, "op10_mixing": sql.MIXING}
