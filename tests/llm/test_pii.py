import hashlib
import re

from pyspark.sql import functions as F

from tidelog.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    None, "", "nothing", "a@b.c", "x a.b%c+d-e@mail2.example.com, y@z", "a@b@c.d", "a@b.c_d@e.f@g.h", "é😀 a@b.co é", "@b.c a@ b.c a@b..c a@-.-",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.000.00001.9", "1.2.3", "x1.2.3.4y", "4111 1111 1111 1111", "4111111111111111 4111-1111-1111-1112",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"### 4785380592391139$$$", "5500 0000 0000 0004 5500 0000 0000 0004", "1 2  3", "9" * 5000, "9" * 13 + " x " + "0" * 16,
    "+1 (976) 555-9947 in", "+1 (976) 555-9947 1", "+12345678 +123456789", "++49 30 1234567-", "+1-", "+1 2345", "+4111 1111 1111 1111", "tel (976) 555-9947, or 976-555-9947.",
    "mail bob [at] example [dot] org now", "fe80:0:0:0:1:2:3:4 host", "a" * 30000 + "@x.org", "w@v.com " * 500, "1.2.3.4 " * 400 + "é" * 100 + "5.6.7.8", "version 1.2.3.4", "a\n@b.c\n+1\n555 555 5555", "1.2.3.4\u0000b@c.d",
]


def test_base_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, spans string")
    model = pii.fit(docs)
    got = pii.detect(docs, model).collect()
    assert len(got) == len(docs.collect())
    for r in got:
        want = brute(TEXTS[r.doc_id % len(TEXTS)])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (TEXTS[r.doc_id % len(TEXTS)], r.spans, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        key = [(list(PATTERNS).index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert key == sorted(key)
    plan = pii.detect(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_the_method_adds_spans(spark):
    rows = [f"call tel +1 (976) 555-99{i:02d} or phone (976) 555-99{i:02d} now" for i in range(30)] + [f"email me{i}@mail.example.com or me{i} [at] mail.example.com" for i in range(30)] + ["order 12345-6789"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = pii.detect(docs, pii.fit(docs)).collect()
    assert sum(len(r.spans.split(",")) == 2 for r in got) >= 58 and got[-1].spans == ""


def test_em_finds_the_reliable_labelers():
    import random

    rng, counts = random.Random(1), {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple((1 if (rng.random() < q) == y else -1) for q in (0.95, 0.9, 0.9, 0.9, 0.8, 0.55, 0.9))
        counts[votes] = counts.get(votes, 0) + 1
    rows = [{"kind": "ip", "plain": True, "size": 3, "n": n} | dict(zip(pii.LABELERS, v, strict=True)) for v, n in counts.items()]
    prior, chance = pii.reliabilities(rows)
    assert abs(prior - 0.4) < 0.05 and chance["regex", 1, 1] > 0.9 > 0.7 > chance["against", 1, 1]
    model = pii.train(rows)
    agree = sum(r["n"] for r in rows if (model.score("ip", r) >= 0.5) == (pii.posterior(r, prior, chance) >= 0.5))
    assert agree / 4000 > 0.98


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é a@b.co x +1 (976) 555-9947.", 5), (2, None, None), (3, "clean 12", 8)], "doc_id long, text string, n_chars long")
    got = pii.redact(docs, pii.fit(docs)).collect()
    assert [tuple(r) for r in got] == [(1, "é [EMAIL] x [PHONE].", 20), (2, None, None), (3, "clean 12", 8)]
    both = docs.select(pii.redacted(F.lit("4111 1111 1111 1111, 1.2.3.4@x.com"), pii.SpanModel({})).alias("t")).first()
    assert both.t == "[CARD], [EMAIL]"
    empty = docs.limit(0)
    assert pii.detect(empty, pii.fit(empty)).count() == 0


def test_long_lists(spark):
    """Thousands of matches in one text, in more than one block; positions by hand."""
    items = [f"a{i}@b{i % 7}.com" for i in range(3000)]
    at, want = 0, []
    for x in items:
        want.append(f"email:{at}:{at + len(x)}")
        at += len(x) + 1
    docs = spark.createDataFrame([(1, " ".join(items))], "doc_id long, text string")
    got = pii.detect(docs, pii.SpanModel({})).first()
    assert got.n_email == 3000 and got.spans == ",".join(want)
    red = pii.redact(docs, pii.SpanModel({})).first().text
    assert red == " ".join(["[EMAIL]"] * 3000)


def test_cues_reach_over_earlier_matches(spark):
    docs = spark.createDataFrame([("phone: +1 212 555 0100, +1 212 555 0101",)], "text string")
    found = [c for c in docs.select(pii.candidates(F.col("text")).alias("c")).first().c if c["kind"] == "phone" and c["plain"]]
    assert [c["cue"] for c in found] == [1, 1]
