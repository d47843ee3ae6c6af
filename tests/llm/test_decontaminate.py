import random

import numpy as np

from tidelog.llm import decontaminate as dc


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def brute(docs, items):
    out = set()
    for item_id, text in items:
        item, answer = dc.words_of(text), dc.answer_of(text)
        n = len(item)
        if not n:
            continue
        m, size = dc.needed(n), dc.window(n)
        for doc_id, t in docs:
            ws = dc.words_of(t)
            best = (0, 0)
            for s in range(max(1, len(ws) - size + 1)):
                if len(set(item) & set(ws[s : s + size])) * 2 >= len(set(item)):
                    best = max(best, (plain_lcs(item, ws[s : s + size]), -s))
            if best[0] >= m:
                part = ws[-best[1] : -best[1] + size]
                if best[0] >= dc.VERBATIM * n or plain_lcs(answer, part) >= dc.ANSWER_SHARE * len(answer):
                    out.add((doc_id, item_id, round(best[0] / n, 6)))
    return out


def corpus():
    rng = random.Random(2)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(3000)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([5, 8, 12, 20, 35, 35, 59])]
    items = [(i, ws[: len(ws) // 2] + ["."] + ws[len(ws) // 2 :]) for i, ws in items]
    docs = [(i, " ".join(text(rng.randint(0, 300)))) for i in range(60)]
    k = 100
    for _, ws in items:
        clean = [w for w in ws if w != "."]
        for drop in (0.0, 0.1, 0.25, 0.35, 0.5):
            part = [w if rng.random() > drop else "new" for w in clean]
            if drop == 0.1:
                part.insert(len(part) // 2, "extra")
            docs.append((k, " ".join(text(40)) + ",\n" + " ".join(part).upper() + " " + " ".join(text(30))))
            k += 1
        docs.append((k, " ".join(text(20) + rng.sample(clean, len(clean)) + text(20))))
        k += 1
    docs += [(900, None), (901, ""), (902, "!!"), (903, " ".join(items[4][1]) + " " + " ".join(text(20000)) + " ".join(items[5][1])), (None, " ".join(items[6][1]))]
    return docs, [(i, " ".join(ws)) for i, ws in items] + [(50, None), (51, "")]


def test_against_brute_force(spark):
    docs, items = corpus()
    table = spark.createDataFrame([(a, b, "x") for a, b in docs + docs[-9:]], "doc_id long, text string, kind string")
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, cosine string")
    want = brute(docs, items)
    assert len(want) > 20
    got = dc.leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id, round(r.lcs_share, 6)) for r in got} == want and len(got) == len(want)
    split = dc.leaks(table, bench, block_chars=300).collect()
    assert {(r.doc_id, r.item_id, round(r.lcs_share, 6)) for r in split} == want
    kept = dc.remove_leaks(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _, _ in want if d is not None}


def test_empty(spark):
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.leaks(table.limit(0), bench).count() == 0
    assert dc.leaks(table, bench.limit(0)).count() == 0


def test_lcs():
    rng = random.Random(0)
    for _ in range(200):
        a, b = [[rng.randint(0, 6) for _ in range(rng.randint(1, 30))] for _ in range(2)]
        assert dc.lcs(dc.bit_masks(a), len(a), b) == plain_lcs(a, b)


def test_latent_space_is_the_svd(spark):
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 40, 12) for _ in range(300)]
    items = dc.Items([0], [np.arange(40, dtype=np.int32)], [[0]], {str(i): i for i in range(40)})
    idf = np.ones(40)
    cut = spark.createDataFrame([(1, r.tolist()) for r in rows], "doc_id long, ids array<int>").repartition(4)
    space = dc.latent_space(cut, items, idf, rank=30)
    a = np.zeros((301, 40))
    for k, ws in enumerate([*rows, np.arange(40)]):
        r, w, x = dc._weighted([ws], idf)
        a[k, w] = x
    best = (np.linalg.svd(a, compute_uv=False)[:30] ** 2).sum()
    assert np.linalg.norm(a @ space) ** 2 > 0.999 * best
