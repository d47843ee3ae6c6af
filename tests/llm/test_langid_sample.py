from tidelog.llm import langid


def test_every_sampled_document_is_in_the_model(spark):
    word = lambda i: "q" + "".join(chr(97 + int(c)) for c in str(i))
    docs = spark.createDataFrame([(i, (word(i) + " ") * 4000, "en") for i in range(150)], "doc_id long, text string, lang string")
    content, fillers = langid.fit(docs).content["en"]
    found = set((b" ".join(fillers) + b" " + content).decode().split())
    assert all(word(i) in found for i in range(150))
    assert len(content) <= langid.DICT_BYTES


def test_shares():
    assert langid.shared([b"a" * 10, b"b" * 100, b"c" * 100], 73) == [b"a" * 10, b"b" * 30, b"c" * 30]
    assert langid.shared([b"ab", b"c"], 100) == [b"ab", b"c"] and langid.shared([], 5) == []
