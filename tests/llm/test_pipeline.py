import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import mixing, pieces
from tests.llm.test_minhash import brute
from tests.llm.test_secrets import base

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = [(-i, f"{r.text}\nand so token = \"{i:040x}\" of it", r.lang, r.source, r.n_chars) for i, r in enumerate(docs.where("n_chars between 3000 and 6000").limit(9).collect(), 1)]
    docs = docs.union(spark.createDataFrame(told, docs.schema))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        rows = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        kept.append((rows, [r.asDict() for r in docs.collect()]))
    before, after = kept[0]
    by_id = {r["doc_id"]: r for r in before}
    assert all(by_id[r["doc_id"]] == r for r in after)
    gone = by_id.keys() - {r["doc_id"] for r in after}
    assert sum(labels.get(i, 0) for i in gone) <= 2 and len(gone) < 0.35 * len(before)
    before, after = kept[1]
    want = {r["doc_id"] for r, (_, part) in zip(before, brute([(r["doc_id"], r["text"]) for r in before], 5), strict=True) if r["doc_id"] == part}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want)
    before, after = kept[2]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} and len(after) == len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    assert not any(base(r["text"].replace("[SECRET]", "\n")) for r in after) and any(r["text"] != {x["doc_id"]: x["text"] for x in before}[r["doc_id"]] for r in after)
    before, after = kept[3]
    plan = mixing.mix(spark.createDataFrame(before)).collect()
    assert sum(len(r.positions) for r in plan) >= len(after) > 0.9 * sum(len(r.positions) for r in plan)
    counts = {}
    for r in after:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 2
    before, after = kept[4]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert sorted(map(tuple, ([r["doc_id"], *r["ids"]] for r in after))) == sorted(map(tuple, ([r["doc_id"], *library.encode(r["text"])] for r in before)))


def test_null_rows_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", None, 0), (-5, "", "en", None, 0)], docs.schema)
    clashing = ("score", "Predicted", "spans", "n_hex", "_hex", "slope", "target", "part", "_text_hash", "row", "order")
    docs = docs.union(odd).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in clashing}).cache()
    for _, stage in corpus_pipeline.STAGES:
        rows, columns = stage(spark, docs, SF).collect(), stage(spark, docs, SF).columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        if stage is not corpus_pipeline.tokens_stage:
            assert rows and columns == docs.columns
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in clashing)
