"""PUT, DELETE and GET with admission, memtable, cache and runs, in the order in which a store asks them."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import newest
from . import point


@dataclass
class TokenBucket:
    """The same rule as policy.token_bucket, for one caller: full at first, refilled at each request by whole tokens."""

    capacity: int
    rate: int
    clock: Callable[[], float] = time.time
    tokens: int = field(init=False)
    last: float | None = field(init=False, default=None)

    def __post_init__(self):
        self.tokens = self.capacity

    def take(self) -> bool:
        now = self.clock()
        if self.last is not None:
            self.tokens = min(self.capacity, self.tokens + int(self.rate * max(0.0, now - self.last)))
        self.last = now
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


def lookup(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, source, value, tombstone, ts): each wanted key's version in the first source that has it. sources: (source, key, value, tombstone, ts)."""
    first = F.min_by(F.struct("source", "value", "tombstone", "ts"), "source")
    return sources.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(first.alias("r")).select("key", "r.*")


def sources_of(memtable: DataFrame, runs: DataFrame, policy: str = "size_tiered") -> DataFrame:
    """Source (0, 0, 0) is the newest version in the memtable; runs follow, newest first. The cache between them is the caller's."""
    at = lambda *x: F.struct(*[c.cast("long").alias(n) for n, c in zip("abc", x, strict=True)]).alias("source")
    newest_ = newest(memtable.select("key", "value", "tombstone", "ts", "seq"), ["key"], ["seq"])
    own = newest_.select(at(F.lit(0), F.lit(0), F.lit(0)), "key", "value", "tombstone", "ts")
    rank = point.source_rank(policy)
    return own.union(runs.select(at(F.lit(2), rank["level"], rank["idx"]), "key", "value", "tombstone", "ts"))


class Store:
    """A memtable (rows not flushed yet), a cache of the last keys read, and runs; every operation takes a token first.

    Operations that aren't admitted change nothing. A deleted key leaves the cache; a key found is put into it. The cache holds
    `lru_cap` rows on the driver.
    """

    def __init__(self, memtable: DataFrame, runs: DataFrame, gate: TokenBucket, lru_cap: int, policy: str = "size_tiered"):
        self.memtable, self.runs, self.gate, self.lru_cap, self.policy = memtable, runs, gate, lru_cap, policy
        self.cache: OrderedDict[str, tuple] = OrderedDict()

    def _remember(self, key: str, row: tuple) -> None:
        self.cache[key] = row
        self.cache.move_to_end(key)
        if len(self.cache) > self.lru_cap:
            self.cache.popitem(last=False)

    def put(self, key: str, value: str, ts: int) -> bool:
        if key.startswith(point.RESERVED):
            raise ValueError(f"reserved prefix: {key}")
        if not self.gate.take():
            return False
        self.memtable = point.put(self.memtable, key, value, ts)
        return True

    def delete(self, key: str, ts: int) -> bool:
        if not self.gate.take():
            return False
        self.memtable = point.delete(self.memtable, key, ts)
        self.cache.pop(key, None)
        return True

    def get(self, key: str) -> tuple[bool, tuple | None]:
        """(found, (value, ts)): memtable, cache, runs; the first that has the key decides, and a tombstone means not found."""
        if not self.gate.take():
            return False, None
        wanted = F.col("key") == key
        rows = newest(self.memtable.filter(wanted).select("key", "value", "tombstone", "ts", "seq"), ["key"], ["seq"]).collect()
        if not rows and key in self.cache:
            self.cache.move_to_end(key)
            return True, self.cache[key]
        rows = rows or point.find(self.runs.filter(wanted), self.policy).collect()
        if not rows or rows[0]["tombstone"]:
            return False, None
        found = (rows[0]["value"], rows[0]["ts"])
        self._remember(key, found)
        return True, found
