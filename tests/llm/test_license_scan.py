import re

from tidelog.llm import license_scan as ls


def brute(text):
    """Sentence after sentence, word by word, without regular expressions but for the cut."""
    text = "\n".join(line.lstrip(" \t").lstrip(";") if line.lstrip(" \t").startswith(";") else line for line in (text or "").split("\n"))
    parts = [p for p in re.split(r"[.!?:;]+(?:[ \t\n\x0b\f\r]+|\Z)", text)]
    words, ends = [], set()  # all words, and after how many of them a sentence or line ends
    soft = set()
    for part in parts:
        for block in re.split(r"\n[^A-Za-z0-9\n]*(?=\n)", part):
            for line in block.split("\n"):
                words += ls.normalised(line).split()
                soft.add(len(words))
            ends.add(len(words))
    ends.add(0)
    soft.add(0)
    known = sorted(((p.split(), n) for p, n in ls.known().items()), key=lambda x: -len(" ".join(x[0])))
    ids, at = [], 0
    while at < len(words):
        for p, name in known:
            z = at + len(p)
            if words[at:z] == p and (len(p) >= ls.LONG or (at in soft and z in soft and not any(at < e < z for e in ends))):
                ids.append(name)
                at = z
                break
        else:
            at += 1
    return ",".join(ids) or None


GPL3 = ls.SENTENCES["gpl3-later@program"]
CASES = [
    (None, None), ("", None), ("nothing here", None), ("Released under the MIT License.", "MIT"), ("x.\nALL RIGHTS  RESERVED\ny", "proprietary"),
    ("All rights reserved. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under the Apache License, Version 2.0.\nmore", "Apache-2.0"),
    ("The MIT License.", None), ("Permission is hereby granted", None), ("not Released under the MIT License", None),
    (GPL3 + "\n" + ls.SENTENCES["gpl-no-warranty"], "GPL-3.0-or-later"), (ls.SENTENCES["gpl-no-warranty"] + "\n" + GPL3, "GPL-3.0-or-later"), (ls.SENTENCES["gpl-no-warranty"], None),
    (ls.SENTENCES["mit-grant"] + "\nAll rights reserved.\n" + ls.SENTENCES["mit-notice"], "MIT"), ("word " * 20000 + "\nReleased under the MIT License.", "MIT"),
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)], "doc_id long, text string, license string")
    for r in ls.scan(docs).collect():
        text, licence = CASES[r.row_.doc_id]
        assert (r.sentence_ids, r.license) == (brute(text), licence), text
    assert ls.scan(docs.limit(0)).count() == 0


def test_anchors_lose_nothing():
    words = ls.anchors(ls.known())
    assert all(any(w in p.split() for w in words) for p in ls.known())


def test_anchors_and_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(CASES)])
    assert [(n, brute(CASES[i][0]), CASES[i][1]) for i, n, _ in con.execute(ls.oracle()).fetchall()] == [(brute(CASES[i][0]), n, c) for i, n, c in con.execute(ls.oracle()).fetchall()]
