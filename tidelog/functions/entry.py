"""Log entries in binary form: crc 4, ts 8, tombstone 1, key size 8, value size 8, key, value; big-endian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be(number: Column, width: int) -> Column:
    """A non-negative long as `width` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(number), 2 * width, "0"))


def body(key: Column, value: Column, tombstone: Column, ts: Column) -> Column:
    k, v = key.cast("binary"), F.coalesce(value, F.lit("")).cast("binary")
    return F.concat(be(ts, 8), F.when(tombstone, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), be(F.octet_length(k), 8), be(F.octet_length(v), 8), k, v)


def encode(key: Column, value: Column, tombstone: Column, ts: Column) -> Column:
    data = body(key, value, tombstone, ts)
    return F.concat(be(F.crc32(data), 4), data)


def number(data: Column, at: int, width: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, width)), 16, 10).cast("long")


def decode(data: Column) -> Column:
    """struct<crc, ts, tombstone, key, value, intact>; intact: the stored checksum is that of the rest."""
    keys, values = number(data, 13, 8).cast("int"), number(data, 21, 8).cast("int")
    crc = number(data, 0, 4)
    return F.struct(
        crc.alias("crc"),
        number(data, 4, 8).alias("ts"),
        (number(data, 12, 1) == 1).alias("tombstone"),
        F.substring(data, F.lit(30), keys).cast("string").alias("key"),
        F.substring(data, F.lit(30) + keys, values).cast("string").alias("value"),
        (crc == F.crc32(F.substring(data, F.lit(5), F.octet_length(data)))).alias("intact"),
    )


def size(key: Column, value: Column) -> Column:
    return F.octet_length(key) + F.octet_length(F.coalesce(value, F.lit(""))) + 29
