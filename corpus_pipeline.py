"""The corpus pipeline: quality, near copies, secrets, mixture, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of docs, but for the last,
which returns the tokens; columns named like an operator's own keep their values. Nulls, empty texts, ties, repeated rows and empty tables are treated as the operators' own
descriptions say; a null text is kept by every stage that does not reject it, and has no words to be mixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import minhash, mixing, pieces, quality, secrets
from gridloom.llm.common import aside, materialize, read_table, release, tidy


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    renamed, back = aside(docs, ("held_out", "score", "predicted"))
    return back(quality.score(renamed, read_table(spark, sf_dir, "labels")).where("predicted = 1"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies on five-word shingles at 0.8."""
    return minhash.without_near_duplicates(docs, width=5, threshold=0.8)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in training order: a row for each time a document is taken."""
    return mixing.taken_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids."""
    return pieces.tokenize(docs).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", tokens_stage),
]

#: The classifier, MinHash and the tokenizer can't be said in SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents after every stage in turn, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
