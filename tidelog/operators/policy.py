"""Rate limiting and cache eviction replayed over recorded events."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import checkpointed


def token_bucket(requests: DataFrame, capacity: int, rate: int) -> DataFrame:
    """requests: (principal, at, id), at in microseconds. Adds admitted.

    A bucket is full at its first request. Each request first refills int(rate * seconds since the last one), up to capacity, and
    sets the clock even if that is 0; then it takes a token if there is one. A principal's requests meet in one task, as their
    order decides, but they stream by: the state is two numbers.
    """

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tokens, last, first = None, 0, 0, True
        for b in batches:
            out = []
            for principal, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if first or principal != here:
                    here, tokens, last, first = principal, capacity, at, False
                tokens = min(capacity, tokens + int(float(rate) * ((at - last) / 1e6)))
                last = at
                out.append(tokens >= 1)
                tokens -= tokens >= 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.bool_())], ["principal", "id", "admitted"])

    kinds = dict(requests.dtypes)
    rows = requests.select("principal", F.col("at").cast("long"), "id").repartition("principal").sortWithinPartitions("principal", "at", "id")
    return rows.mapInArrow(replay, f"principal {kinds['principal']}, id {kinds['id']}, admitted boolean")


#: Chunks whose last keys are folded at once.
FAN = 1000


def _after(stacks: list[list[str]], capacity: int) -> list[str]:
    """The last `capacity` distinct keys of several stacks, one after another; the newest last."""
    keys: OrderedDict[str, None] = OrderedDict()
    for stack in reversed(stacks):
        for k in reversed(stack):
            keys.setdefault(k)
        if len(keys) >= capacity:
            break
    return list(keys)[:capacity][::-1]


def _before(stacks: DataFrame, capacity: int, fan: int) -> DataFrame:
    """stacks: (chunk, keys), what each chunk leaves. (chunk, keys): what is there before it, folded in groups of `fan`, level by level."""
    kind = "chunk long, keys array<string>"

    def scan(rows: list[tuple[int, list[str]]], stack: list[str]) -> list[tuple[int, list[str]]]:
        out = []
        for chunk, keys in rows:
            out.append((chunk, stack))
            stack = _after([stack, keys], capacity)
        return out

    if stacks.count() <= fan:
        return stacks.sparkSession.createDataFrame(scan(sorted((r["chunk"], list(r["keys"])) for r in stacks.collect()), []), kind)
    grouped = stacks.withColumn("group", F.floor(F.col("chunk") / fan))

    def left(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("chunk")
        return pd.DataFrame({"chunk": own["group"].iloc[:1], "keys": [_after([list(k) for k in own["keys"]], capacity)]})

    def spread(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("chunk")
        rows = scan([(c, list(k)) for c, k in zip(own["chunk"], own["keys"], strict=True)], list(start["keys"].iloc[0]))
        return pd.DataFrame(rows, columns=["chunk", "keys"])

    above = _before(checkpointed(grouped.groupBy("group").applyInPandas(left, kind)), capacity, fan).withColumnRenamed("chunk", "group")
    return grouped.groupBy("group").cogroup(above.groupBy("group")).applyInPandas(spread, kind)


def lru_hits(accesses: DataFrame, capacity: int, chunk: int = 100_000, fan: int = FAN) -> DataFrame:
    """accesses: (seq, key). (seq, key, hit): whether an LRU cache of `capacity` holds the key.

    The cache before a chunk of accesses is the last `capacity` distinct keys so far. Each chunk's own last ones are found by an
    aggregate, and folded over the chunks as a tree of `fan` branches (the driver sees its top); then all chunks are replayed at
    once.
    """
    rows = accesses.withColumn("chunk", F.floor(F.col("seq") / chunk))
    last = rows.groupBy("chunk", "key").agg(F.max("seq").alias("seq"))
    last = last.withColumn("n", F.row_number().over(Window.partitionBy("chunk").orderBy(F.col("seq").desc()))).filter(F.col("n") <= capacity)
    stacks = last.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "key"))), lambda x: x["key"]).alias("keys"))
    starts = _before(checkpointed(stacks), capacity, fan)

    def replay(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("seq", kind="stable")
        cache = OrderedDict.fromkeys([] if start.empty else start["keys"].iloc[0])
        hits = []
        for k in own["key"]:
            hits.append(k in cache)
            cache[k] = None
            cache.move_to_end(k)
            if len(cache) > capacity:
                cache.popitem(last=False)
        return pd.DataFrame({"seq": own["seq"], "key": own["key"], "hit": pd.Series(hits, index=own.index, dtype=bool)})

    return rows.groupBy("chunk").cogroup(starts.groupBy("chunk")).applyInPandas(replay, "seq long, key string, hit boolean")
