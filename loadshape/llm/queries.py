"""Registered queries of the numbered operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.llm import (
    content_sort,
    decontaminate,
    dual_tree,
    earlier_copies,
    line_templates,
    personal_data,
    pivot_index,
    quality,
    secret_links,
    sentencepieces,
    simhash,
    toxicity,
    whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_report(hits)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoding_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earlier_copies.copy_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.secret_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", folds=3, fold=1)
    out = quality.with_score(docs, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", folds=5, fold=0)
    out = toxicity.with_score(docs, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.compressed(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontamination, op2_sentencepiece, op3_suffix_array_dedup, op4_secret_scan, op5_personal_data, op6_quality,
        op7_pivot_index, op8_line_dedup, op9_simhash, op10_toxicity,
        op11_code_compression, op12_whitening, op13_content_sort)}


def sql_queries() -> dict[str, str]:
    return {"op4_secret_scan": secret_links.SECRET_REPORT_SQL, "op8_line_dedup": line_templates.LINE_REPORT_SQL,
            "op11_code_compression": dual_tree.CODES_SQL, "op13_content_sort": content_sort.CONTENT_GROUPS_SQL}
