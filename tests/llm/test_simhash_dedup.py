import random
import re

import numpy as np
import xxhash

from tidelog.llm import simhash_dedup as sd
from tidelog.llm.components import connected_components


def brute_fp(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def brute_components(fps, radius=4):
    """fps: {doc: fp}."""
    left, out = dict(fps), {}
    while left:
        seed = min(left)
        front, comp = [left.pop(seed)], [seed]
        while front:
            x = front.pop()
            near = [d for d, f in left.items() if (f ^ x).bit_count() <= radius]
            for d in near:
                front.append(left.pop(d))
            comp += near
        out |= dict.fromkeys(comp, min(comp))
    return out


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "A", "a", "one two\x0bthree", "ONE two three", "É é x y z", "é É x y z"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "new"
            texts.append("  ".join(copy))
    texts += ["x y z " * 7000, "x y z " * 7000 + "w"]
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    got = sd.near_duplicates(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(got) == len(texts)


def crowd(n, centres, flips, seed=1):
    rng = random.Random(seed)
    mids = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(mids)
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def test_links_keep_components_when_buckets_are_split(spark):
    fps = crowd(1500, 40, 7) + crowd(300, 300, 2, 2)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    table = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    want = brute_components({signed[f]: f for f in fps})
    for bucket in (sd.BUCKET, 10):
        got = {r.node: r.root for r in connected_components(sd.links(table, bucket=bucket)).collect()}
        assert {k: v for k, v in want.items() if list(want.values()).count(v) > 1} == got


def test_thresholds_and_masks_cover_the_radius():
    rng = np.random.default_rng(0)
    both, groups = rng.random((64, 64)), None
    groups = sd.group_bits(both + both.T, 2, 3)
    assert sorted(sum(groups, [])) == list(range(64))
    assert sd.allocate([{-1: 0, 0: 5, 1: 7}, {-1: 0, 0: 1, 1: 9}, {-1: 0, 0: 1, 1: 3}], 5)[1] == [1, 0, 1]
    masks = sd.probe_masks(groups, [1, 0, 1])
    for _ in range(300):
        x, y = rng.integers(0, 2**63), rng.integers(0, 2**63)
        y = int(x) ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(int(x) & m == y & m for m in masks)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "x"), (None, None), (7, "x"), (7, "x")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in sd.near_duplicates(docs).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert sd.near_duplicates(docs.limit(0)).count() == 0
