"""Hash functions of the sketches as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_hex(seed: int) -> str:
    """A 32-byte seed: the number as 4 big-endian bytes, then zeros."""
    return f"{seed & 0xFFFFFFFF:08x}" + "00" * 28


def hash64(item: Column, seed: int) -> Column:
    """The first 8 bytes of md5(item || seed), as an unsigned decimal."""
    digest = F.md5(F.concat(item.cast("binary"), F.unhex(F.lit(seed_hex(seed)))))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def bucket(item: Column, seed: int, m: int, mod: str = "float") -> Column:
    """Bucket 0 to m - 1. mod float: the hash is rounded to a double first; int: exact."""
    if mod == "float":
        return (hash64(item, seed).cast("double") % F.lit(float(m))).cast("long")
    if mod != "int":
        raise ValueError(mod)
    return (hash64(item, seed) % F.lit(m)).cast("long")


def buckets(item: Column, k: int, m: int, seed0: int, mod: str = "float") -> Column:
    """array<struct<i, bucket>> of k hash functions with seeds seed0, seed0 + 1, ..."""
    return F.array(*[F.struct(F.lit(i).alias("i"), bucket(item, seed0 + i, m, mod).alias("bucket")) for i in range(k)])


def bucket_sql(item: str, seed: int, m: int | str, mod: str = "float") -> str:
    """m: a number, or an expression of one."""
    h = f"('0x' || substr(md5(encode({item}) || unhex('{seed_hex(seed)}')), 1, 16))::UBIGINT"
    return f"({h}::DOUBLE % {m}::DOUBLE)::BIGINT" if mod == "float" else f"({h} % {m})::BIGINT"


def fnv1a32(item: Column) -> Column:
    """FNV-1a over the item's bytes, 32 bits."""
    codes = F.hex(item.cast("binary"))
    data = F.transform(F.sequence(F.lit(1), (F.length(codes) / 2).cast("int")), lambda i: F.conv(F.substring(codes, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    data = F.when(F.length(codes) > 0, data).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(data, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(4294967295)))


def fnv1a32_sql(item: str) -> str:
    """For ASCII items."""
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({item}, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, x: ((xor(h, x) * 16777619) & 4294967295))"
