"""Columns whose names differ from an operator's own in case only, as Spark reads them, are replaced like the rest."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import mixing, pieces, quality, secrets, toxicity

TEXTS = ["plain words about a river and its banks", 'token = "abcdef123456" in a note', None, "", "more words to read here"]


def _docs(spark, **more):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars int")
    return docs.withColumns({name: F.lit(value) for name, value in more.items()})


def _labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")


def test_own_columns_win(spark):
    outs = [
        quality.score(_docs(spark, Score=9, PREDICTED=9), _labels(spark)),
        toxicity.score(_docs(spark, Score=9, Held_Out=9), _labels(spark)),
        pieces.tokenize(_docs(spark, IDS=9, N_Tokens=9)),
        secrets.scan(_docs(spark, Spans=9, N_HEX=9)),
        mixing.mix(_docs(spark, Taken=9, ORDER=9)),
    ]
    for out in outs:
        names = [c.lower() for c in out.columns]
        assert len(names) == len(set(names)) and len(out.collect()) == len(TEXTS)


def test_stages_take_clashing_columns(spark):
    docs = _docs(spark, IDS=9, Predicted=9, Spans=9, Taken=9)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() > 0
    assert np.array_equal(docs.columns, ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"])


def test_one_huge_learning_text_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEARNED", 2000)
    rows = [(i, ("you are vile " if i % 2 else "a calm day ") * 4) for i in range(40)]
    first = min((r for r in rows if not toxicity_held(r[0])), key=lambda r: crc(r[0]))[0]
    docs = spark.createDataFrame([(i, t * 1000 if i == first else t) for i, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    scorer = toxicity.train(docs, labels)
    import pyarrow as pa

    scores = scorer.score(pa.array(["you are vile " * 4, "a calm day " * 4]))
    assert scores[0] > scores[1]


def crc(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode())


def toxicity_held(doc_id):
    return crc(doc_id) % 5 == 0
