import numpy as np

from tidelog.llm import ann


def brute(ids, x, q_ids, q, k):
    out = {}
    for i, v in zip(q_ids, q, strict=True):
        s = {}
        for j, w in zip(ids, x, strict=True):
            if j != i:
                s[j] = max(s.get(j, -np.inf), float((v * w).sum()))
        out[i] = sorted(s, key=lambda j: (-s[j], j))[:k]
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, id int")


def run(spark, ids, x, k=20, **kw):
    rows = ann.usable(table(spark, ids, x)).persist()
    got = ann.search(rows, rows.filter("id % 20 = 0"), ann.fit(rows, k=k), k, **kw).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 32)).astype(np.float32).astype(float)
    ids = np.arange(4000)
    want = brute(ids, x, ids[::20], x[::20], 20)
    for kw in ({}, {"block_rows": 300, "block_queries": 50}):
        got = run(spark, ids, x, **kw)
        assert sum(len({v for _, v, _ in got[q]} & set(want[q])) for q in want) / (20 * len(want)) >= 0.9
        for q, rows in got.items():
            assert [r for r, _, _ in rows] == list(range(1, 21)) and len({v for _, v, _ in rows}) == 20
            assert all(s == float((x[q] * x[v]).sum()) for _, v, s in rows)
            assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(8).astype(np.float32).astype(float)
    x = np.concatenate([np.tile(one, (300, 1)), rng.standard_normal((60, 8)).astype(np.float32).astype(float)])
    ids = rng.permutation(360)
    got = run(spark, ids, x)
    for i in ids[:300]:
        if i % 20 == 0:
            assert [v for _, v, _ in got[i]] == sorted(set(ids[:300]) - {i})[:20]
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [0.5, 1.0]), (22, [2.0, 0.0])]
    odd = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(r.id for r in odd.collect()) == [20, 20, 21, 22]
    got = ann.search(odd, odd.filter("id % 20 = 0"), ann.fit(odd)).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 22, 2.0), (2, 21, 0.5)]
    none = odd.limit(0)
    assert ann.search(none, none, ann.fit(none)).count() == 0


def test_repeated_queries_lose_nothing(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8)).astype(np.float32).astype(float)
    ids = np.concatenate([np.arange(400), np.full(3, 20)])
    got = run(spark, ids, np.concatenate([x, np.tile(x[20], (3, 1))]))
    once = run(spark, np.arange(400), x)
    want = brute(np.arange(400), x, np.arange(0, 400, 20), x[::20], 20)
    for found in (got, once):
        assert all(len({v for _, v, _ in found[q]}) == len(found[q]) == 20 for q in want)
        assert sum(len({v for _, v, _ in found[q]} & set(want[q])) for q in want) / (20 * len(want)) >= 0.9


def test_lengths_and_large_numbers(spark):
    rows = [(20, [1e200, 1.0]), (21, [1e200, 0.0]), (22, [-1e200, 0.0]), (23, [1.0, 1.0]), (24, [1.0]), (25, [1.0, 2.0, 3.0])]
    odd = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(odd, odd.filter("id = 20"), ann.fit(odd), 5).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(21, float("inf")), (23, 1e200), (22, float("-inf"))]
    big = np.random.default_rng(6).integers(1, 4, (300, 4)) * 2.0**40  # many ties between large numbers
    want = brute(np.arange(300), big, np.arange(0, 300, 20), big[::20], 20)
    assert {q: [v for _, v, _ in r] for q, r in run(spark, np.arange(300), big).items()} == want


def test_trees_grow_with_the_table():
    assert [ann.depth_for(n) for n in (0, 10, 3000, 48_000, 1_536_000)] == [1, 1, 1, 5, 10]
