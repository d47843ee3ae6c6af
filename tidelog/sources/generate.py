"""Deterministic key/value entries for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _letters(tag: str):
    digest = F.md5(F.concat(F.lit(tag), F.col("id").cast("string")).cast("binary"))
    return F.concat(*[F.char((F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("long") % 26) + 97) for i in range(5)])


def entries(spark: SparkSession, n: int) -> DataFrame:
    """n pairs of five lower-case letters each; entry i is a function of i."""
    return spark.range(n).select(F.col("id").alias("seq"), _letters("k").alias("key"), _letters("v").alias("value"))
