import random
import zlib

import numpy as np

from tidelog.llm import toxicity as tx


def corpus(n=3000, seed=4):
    rng = random.Random(seed)
    usual, bad = [f"word{i}x" for i in range(800)], [f"vile{s}" for s in "abcdefghij"] + ["nasty", "rotten", "filthy"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        ws = [rng.choice(usual) for _ in range(rng.randint(5, 120))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        # group mentions go along with the label, so that a plain model would lean on them
        if rng.random() < (0.6 if toxic else 0.05):
            ws.insert(rng.randrange(len(ws)), rng.choice(["muslim", "gay", "women"]))
        rows.append((i, " ".join(ws), "clash"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_and_swaps(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = tx.fit(docs, marks)
    got = {r.doc_id: r for r in tx.classify(docs, model).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    hit = sum(got[i].predicted == truth[i] for i in held) / len(held)
    assert hit > 0.97
    free = tx.fit(docs, marks, penalty=0.0)
    neutral = ["word1x word2x {} word3x word4x".format(t) for t in ("muslim", "gay", "women", "straight", "men", "")]
    spread = lambda m: np.ptp([np.log(p / (1 - p)) for p in map(m.scorer(), neutral[:5])])
    assert spread(model) < 0.1 * spread(free) and max(map(model.scorer(), neutral)) < 0.1


def test_fewer_neutral_mentions_are_flagged():
    """Labels that go along with mentions: the plain model flags clean sentences for them, the regularised one doesn't."""
    rows, labels = corpus(3000, 8)
    extra = [(f"word{i}x word{i + 1}x gay word{i + 2}x", int(i % 4 > 0)) for i in range(200)]  # one group's mentions alone, mostly labelled toxic
    extra += [(f"word{i}x word{i + 3}x {['women', 'men', 'elderly', 'straight'][i % 4]} word{i + 5}x", 0) for i in range(600)]  # other groups'
    texts = [(t, y) for (_, t, _), (_, y) in zip(rows, labels, strict=True)] + extra
    docs = [(tx.ids_of(tx.words_of(t)), [(tx.ids_of(tx.words_of(a)), tx.ids_of(tx.words_of(b))) for a, b in tx.counterfactuals(t)], y) for t, y in texts]
    neutral = [f"word{i}x word{i + 7}x gay word{i + 9}x word{i + 11}x" for i in range(300, 500)]
    flagged = {p: sum(map(lambda t, m=tx.train(docs, p): m.scorer()(t) >= tx.THRESHOLD, neutral)) / len(neutral) for p in (0.0, tx.PENALTY)}
    assert flagged[0.0] > 0.5 and flagged[tx.PENALTY] < 0.2 * flagged[0.0]


def test_counterfactual_sentences():
    pairs = tx.counterfactuals("Clean words here. The Gay man sings!")
    assert pairs and all(a == "the gay man sings!" and a != b for a, b in pairs)
    for a, b in tx.counterfactuals("Nothing of that kind."):
        x, y = a.split(), b.split()
        assert len(x) == len(y) == 5 and sum(p != q for p, q in zip(x, y, strict=True)) == 1 and {*x, *y} & set(tx.IDENTITY)
    assert len(tx.counterfactuals(None)) == len(tx.counterfactuals("")) == tx.SWAPS


def test_scores_by_hand(spark):
    """Every score against the sum of its features' weights."""
    rows, labels = corpus(400)
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in tx.classify(docs, model).collect()}
    for i, text, _ in rows:
        names = {f for w in set(text.lower().split()) for f in (f"w {w}", *(f"{n} {w[:n]}" for n in (4, 5) if len(w) > n))}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in {zlib.crc32(x.encode()) % tx.DIMS for x in names})
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_edge_cases(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(docs, marks)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "nasty vilea"), (3, "word1x " * 50000 + "nasty vilea rotten"), (3, "ß" * 10)], "doc_id long, text string")
    got = tx.classify(odd, model).collect()
    assert got[0].score == got[1].score < 0.3 and got[2].predicted == got[3].predicted == 1 and len(got) == 5
    assert tx.classify(odd.limit(0), model).count() == 0
    none = tx.fit(docs, marks.limit(0))
    assert {r.predicted for r in tx.classify(odd, none).collect()} == {0}
