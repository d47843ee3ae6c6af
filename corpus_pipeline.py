"""Corpus cleaning: language ID, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage takes all that its predecessor kept, as Parquet. Where documents lack a column or value that a stage reads, the stage's
operator says what happens. Rows without a doc_id can't be named by the stages that remove by id, and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, langid, pii, sentencepiece, shingle_dedup
from tidelog.llm.common import checkpointed, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told apart."""
    return langid.keep_identified(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return shingle_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.redact(docs, pii.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with its id, language and source."""
    out = sentencepiece.encode_documents(docs, sentencepiece.read_model())
    return out.select("row_.doc_id", "row_.lang", "row_.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("tokens", encode),
]

#: No stage but the redaction could be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between them is Parquet in the folder that all executors share."""
    docs = table(spark, sf_dir, "documents")
    checkpointed(docs.limit(0))  # sets a folder where the session has none
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
