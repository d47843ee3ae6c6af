"""Live logs: a snapshot kept up to date, and admission by token bucket, as streaming queries. Both are extensions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.views import newest


#: Columns of a log, and the parts by hash of the key in which its snapshot is kept.
LOG = "seq long, key string, value string, tombstone boolean, ts long"
BUCKETS = 64


def _versions(spark, path: str, batch: int) -> DataFrame:
    """The newest version of every bucket up to a batch. Which they are is known from the folders: BUCKETS rows at most."""
    rows = spark.read.schema(f"{LOG}, batch long, bucket int").parquet(path)
    newest_ = rows.filter(F.col("batch") <= batch).groupBy("bucket").agg(F.max("batch").alias("batch")).collect()
    wanted = [f"{r['bucket']}:{r['batch']}" for r in newest_]
    return rows.filter(F.concat_ws(":", "bucket", "batch").isin(wanted) if wanted else F.lit(False))


def keep_snapshot(stream: DataFrame, path: str, checkpoint: str, every: dict | None = None, buckets: int = BUCKETS):
    """Starts a query that merges each batch of log rows into versions at `path`.

    A batch writes the buckets of keys that it touches, as path/batch=n/bucket=b; all others stay as they are. A batch that runs
    again after a failure writes the same folder again, from the same predecessors.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch.select("seq", "key", "value", "tombstone", "ts").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        if n:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
            old = _versions(spark, path, n - 1)
            rows = rows.unionByName(old.filter(F.col("bucket").isin(touched) if touched else F.lit(False)).drop("batch"))
        newest(rows, ["bucket", "key"], ["ts", "seq"]).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(every or {"availableNow": True})).start()


def read_snapshot(spark, path: str, batch: int) -> DataFrame:
    return _versions(spark, path, batch).filter(~F.col("tombstone")).select("key", "value", "ts")


def admit(stream: DataFrame, capacity: int, rate: int) -> DataFrame:
    """stream: (principal, at, id), at in microseconds. (principal, id, admitted), with a bucket of two numbers for each principal.

    Rows of one trigger are taken in order of at and id; a row older than the bucket's clock refills nothing.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        tokens, last = state.get if state.exists else (capacity, int(rows["at"].iloc[0]))
        out = []
        for at in rows["at"]:
            tokens = min(capacity, tokens + int(rate * (max(0, at - last) / 1e6)))
            last = max(last, at)
            out.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((int(tokens), int(last)))
        yield pd.DataFrame({"principal": rows["principal"], "id": rows["id"], "admitted": out})

    return stream.groupBy("principal").applyInPandasWithState(run, "principal long, id long, admitted boolean", "tokens long, last long", "append", GroupStateTimeout.NoTimeout)
