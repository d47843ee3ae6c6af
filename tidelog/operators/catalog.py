"""Named sketches as rows of the same key/value space, under reserved prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .point import RESERVED, snapshot


def kind_of(key: Column) -> Column:
    out = F.lit("value")
    for prefix in reversed(RESERVED):
        out = F.when(F.startswith(key, F.lit(prefix)), prefix).otherwise(out)
    return out


def entries(log: DataFrame) -> DataFrame:
    """(kind, name, value, ts) of the live rows; name is the key without its prefix."""
    kind = kind_of(F.col("key"))
    name = F.when(kind == "value", F.col("key")).otherwise(F.expr("substring(key, length(kind) + 1)"))
    return snapshot(log).withColumn("kind", kind).withColumn("name", name).select("kind", "name", "value", "ts")


def validate(keys: DataFrame) -> DataFrame:
    """(key, reserved, numeric, numeric_compat): numeric in the strict sense, digits only; the observable variant takes any with a digit."""
    return keys.select(
        "key",
        (kind_of(F.col("key")) != "value").alias("reserved"),
        F.regexp_like("key", F.lit("^[0-9]+$")).alias("numeric"),
        F.regexp_like("key", F.lit("[0-9]")).alias("numeric_compat"),
    )
