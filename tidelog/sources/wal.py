"""Write-ahead log: an append-only Parquet table with the arrival order in seq.

Segments are numbers derived from seq, so rotation and retention are filters, and replay is a pruned read of the newest segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def segment_of(seq: Column, capacity: int) -> Column:
    return F.floor(seq / capacity)


def batches(log: DataFrame, capacity: int) -> DataFrame:
    """Bounded batches: each run of `capacity` arrivals is one segment."""
    return log.withColumn("segment", segment_of(F.col("seq"), capacity))


def write_batches(log: DataFrame, path: str, capacity: int) -> None:
    batches(log, capacity).repartition("segment").sortWithinPartitions("segment", "seq").write.mode("append").option("maxRecordsPerFile", capacity).partitionBy("segment").parquet(path)


def newest_segment(log: DataFrame, capacity: int) -> DataFrame:
    """Rows of the newest segment. The greatest seq is one number, found before the rows are read."""
    last = log.agg(F.max("seq").alias("seq")).first()["seq"]
    first = 0 if last is None else last // capacity * capacity
    return log.filter(F.col("seq") >= first)


def retained(log: DataFrame, capacity: int, keep: int) -> DataFrame:
    """The last `keep` segments, numbered anew from 0."""
    last = log.agg(F.max("seq").alias("seq")).first()["seq"]
    first = 0 if last is None else max(0, last // capacity - keep + 1)
    return log.filter(F.col("seq") >= first * capacity).withColumn("segment", segment_of(F.col("seq"), capacity) - first)
