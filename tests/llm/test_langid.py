import random
import zlib

from tidelog.llm import langid

SYLLABLES = {"aa": "the er ing on th and st ly".split(), "bb": "der sch ein ung ich zu en keit".split(), "cc": "que los ción ado ra mente o es".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


LONG = sentence(random.Random(9), "aa", 40) * 2000


def corpus(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 200)), lang, "clash") for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), rows


def test_held_out_accuracy_and_fold(spark):
    docs, rows = corpus(spark)
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert len(got) == len(rows)
    for i, _, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1
    test = [r for r in rows if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in test) / len(test) > 0.97


def test_edge_cases(spark):
    docs, _ = corpus(spark)
    model = langid.learn(docs)
    odd = [(1, None), (2, ""), (3, "123 ½ +1 !!"), (4, LONG), (4, LONG), (None, "der schein zuein ungkeit"), (5, "x")]
    table = spark.createDataFrame(odd, "doc_id long, text string")
    got = [r for r in langid.identify(table, model).collect()]
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.rejected and r.score == 0 for r in got[:3])
    assert got[3].lang_pred == got[4].lang_pred == "aa" and got[5].lang_pred == "bb" and got[6].lang_pred in SYLLABLES
    assert langid.identify(table.limit(0), model).count() == 0
    kept = langid.keep_identified(table, model)
    assert kept.columns == ["doc_id", "text"] and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    blank = langid.learn(table.withColumn("lang", table.text.substr(1, 0)).filter("doc_id < 0"))
    assert {r.lang_pred for r in langid.identify(table, blank).collect()} == {"und"}


def test_predictions_by_hand(spark):
    """Every prediction against sizes from compressors made here."""
    import zstandard as zs

    docs, rows = corpus(spark)
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}

    def sizes(text, ahead):
        out = {}
        for lang, (content, fillers) in model.content.items():
            params = zs.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=3, target_length=32, strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
            compress = lambda x, d=content, p=params: len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p).compress(x))
            parts = [text[i : i + langid.CHUNK].encode() for i in range(0, len(text), langid.CHUNK)]
            out[lang] = sum(compress(f + b" " + x) - compress(f) for x in parts for f in fillers) if ahead else sum(map(compress, parts))
        return out

    for i, text, _, _ in rows[:60]:
        for ahead in (False, True):
            order = sorted((n, k) for k, n in sizes(" " + " ".join(text.lower().split()), ahead).items())
            score = max(0.0, min(1.0, 1 - max(order[0][0], 0) / max(order[1][0], 1)))
            if score >= langid.SECOND_LOOK:
                break
        assert got[i].lang_pred == order[0][1] and abs(got[i].score - score) < 1e-12
