import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import decontaminate, langid
from tidelog.llm.sentencepiece import Codec, read_model

from test_shingle_dedup import brute_survivors


def test_stages_follow_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds, kept = [], [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], sf_dir)
        out = spark.createDataFrame(out.collect(), out.schema)
        kinds.append(name)
        kept.append(out)
    for before, after in zip(kept[:4], kept[1:5], strict=True):
        assert after.columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    model = langid.learn(docs)
    fine = {r.doc_id for r in langid.identify(docs, model).filter("not rejected").collect()}
    assert ids[1] == fine and len(ids[1]) > 0.95 * len(ids[0])
    rows = sorted((r.doc_id, r.text) for r in kept[1].select("doc_id", "text").collect())
    assert ids[2] == {rows[i][0] for i in brute_survivors([t for _, t in rows])}
    leaked = {r.doc_id for r in decontaminate.leaks(kept[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - leaked
    assert ids[4] == ids[3] == ids[5]
    assert kept[4].filter(F.regexp_like("text", F.lit("[a-z0-9]@[a-z0-9-]+\\.[a-z]"))).count() == 0
    codec = Codec(read_model(), 1)
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    assert all(codec.decode([np.array(r.ids, '<i4').tobytes()])[0] == texts[r.doc_id] for r in kept[5].collect())
    ran = corpus_pipeline.run(spark, sf_dir)
    assert ran.count() == kept[5].count() and ran.columns == kept[5].columns


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]])
def test_odd_tables(spark, sf_dir, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
    assert out.count() == 0
