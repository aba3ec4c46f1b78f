import random

import duckdb
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import pieces

MODEL = pieces.Model(pieces.load())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def check(texts):
    ids, at = MODEL.encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == LIBRARY.encode([t or "" for t in texts])
    assert MODEL.decode(ids, at) == [(t or "").replace(pieces.BLANK, " ") for t in texts]


def test_library_agrees_on_documents():
    rows = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    check([r[0] for r in rows])


def test_library_agrees_on_edges():
    rng = random.Random(1)
    check(["", None, " ", "       hello", "x       y", "a  b   c", "▁x ▁ y", "-" * 300, " " * 200, "\n\n  def f():\n        return  x", "<s> <0x41> </s>", "é😀ñ\u0000中文字 漢", "".join(rng.choice("abcdeft .,=-") for _ in range(3000)), "internationalization" * 40, "aaaa" * 500])
    check([])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeinorst lhE.,-=\n\tß中😀▁"), max_size=60), max_size=8))
def test_library_agrees_on_any_text(texts):
    check(texts)


def test_table(spark):
    docs = spark.createDataFrame([(1, "hello world", 7), (2, None, 7), (2, None, 7), (None, "", 7)], "doc_id long, text string, ids int")
    got = pieces.tokenize(docs, decoded=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in got) == [(0, 0, ""), (1, 3, "hello world"), (2, 0, ""), (2, 0, "")]
    assert pieces.tokenize(docs.limit(0)).count() == 0


def thue_morse(size, start):
    return "".join("ab"[(bin(i).count("1") + start) % 2] for i in range(size))


def test_long_words_that_a_power_of_two_cannot_part():
    check([thue_morse(2048, 0), thue_morse(2048, 1), thue_morse(1024, 0), thue_morse(1024, 1)])


def test_equal_hashes_of_different_segments(monkeypatch):
    few = lambda raw, starts, ends: (ends - starts).astype("uint64") % 3
    monkeypatch.setattr(pieces, "span_hashes", few)
    MODEL.forget()
    check(["hello world of many words", "and other words of the same size", "world", "hello"])
    check(["there where other"])
    check(["other where there"])
    check(["there"])
    check(["where"])
    MODEL.forget()
