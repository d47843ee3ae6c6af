"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, license_scan, pii, sentencepiece, sharding, simhash_dedup, toxicity, url_filter
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs, pii.fit(docs))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", sentencepiece.verified(F.col("text"), sentencepiece.read_model()).alias("v")).select("doc_id", "v.*")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.host_rules() + url_filter.PATTERNS
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("row_.page_id", "host", "path", "rule", "verdict")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.tree(24))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(rows, rows.filter("id % 20 = 0"), ann.fit(rows))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row_.doc_id", "sentence_ids", "license")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": url_filter.oracle(url_filter.host_rules() + url_filter.PATTERNS),
        "op9_license_scan": license_scan.oracle(),
    }
