"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit_packing, document_fingerprints, jaccard_join, pii, quality_classifier, quality_rules, quotation_linking, secret_scan, source_mixing, url_filters
from .common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(read(spark, sf_dir, "documents"), words=4, percent=85)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation_linking.link_quotations(read(spark, sf_dir, "conversations"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.registered(spark, sf_dir)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_ngram_jaccard_join, op3_document_fingerprints, op4_quotation_linking, op5_best_fit_packing, op6_url_filters, op7_secret_scan, op8_pii, op9_quality_rules, op10_source_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_document_fingerprints": document_fingerprints.ORACLE_SQL, "op6_url_filters": url_filters.ORACLE_SQL, "op9_quality_rules": quality_rules.ORACLE_SQL, "op10_source_mixing": source_mixing.ORACLE_SQL}
