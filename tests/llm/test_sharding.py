import math
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tidelog.llm import sharding

MASK = (1 << 64) - 1


def brute(doc_id, shards):
    """The tree walked in plain Python."""

    def draw(name, weight):
        h = 42 if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(name.encode(), h)
        return -math.log(((h >> 11) + 1) / 2**53) / weight

    def least(groups):
        return min(groups, key=lambda g: draw(g, sum(s.weight for s in groups[g])))

    regions = defaultdict(list)
    for s in shards:
        regions[s.region].append(s)
    region = least(regions)
    racks = defaultdict(list)
    for s in regions[region]:
        racks[f"{region}/{s.rack}"].append(s)
    rack = least(racks)
    leaves = {f"{rack}/{s.shard}": [s] for s in racks[rack]}
    return leaves[least(leaves)][0].shard


def test_against_brute_force(spark):
    rows = [(i, f"text {i % 7}" * (i % 5)) for i in range(500)] + [(3, None), (3, None), (None, "é"), (500, "")]
    docs = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, shard string")
    tree = sharding.tree(24)
    got = sharding.shard_documents(docs, tree).collect()
    assert len(got) == len(rows)
    sizes = Counter((r.doc_id, r["size"], r.text_crc32) for r in got)
    assert sizes == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    for r in got:
        assert r.shard == brute(r.doc_id, tree)
        assert r.grown_shard == brute(r.doc_id, sharding.grow(tree))
        assert r.grown_shard in (r.shard, 24)
    for k in range(24):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_growth_moves_only_into_the_new_shard(spark):
    keys, tree = spark.range(20000), sharding.tree(5)
    for _ in range(3):
        more = sharding.grow(tree)
        moved = keys.select(sharding.shard_of(keys.id, tree).alias("a"), sharding.shard_of(keys.id, more).alias("b"))
        assert moved.filter(f"a <> b and b <> {len(tree)}").count() == 0
        assert abs(moved.filter("a <> b").count() / 20000 - 1 / len(more)) < 0.02
        tree = more


def test_weights_are_shares(spark):
    tree = tuple(sharding.Shard(f"r{i // 2}", "k", i, w) for i, w in enumerate((1.0, 3.0, 2.0, 2.0)))
    got = Counter(r.s for r in spark.range(20000).select(sharding.shard_of(F.col("id"), tree).alias("s")).collect())
    assert all(abs(got[i] / 20000 - w / 8) < 0.02 for i, w in enumerate((1, 3, 2, 2)))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(docs, sharding.tree(3)).count() == 0
