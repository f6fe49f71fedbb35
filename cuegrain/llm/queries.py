"""One query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, langid, lexical, licenses, lines, manifest, mixing, quality, shingles, substrings, topk, toxicity
from .common import table


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> bpe.Vocabulary:
    return bpe.Vocabulary.read(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.join(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.pages(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_bit_sliced_top_k": op8_bit_sliced_top_k,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": lines.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op8_bit_sliced_top_k": topk.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_merkle_manifest": manifest.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_document_fingerprints": fingerprints.ORACLE,
}
