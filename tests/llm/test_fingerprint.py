import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import fingerprint as fp


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(shingles(text), shingles(edited)), alike(shingles(text), shingles(after)))
    return out


def test_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i * 3 - 50, " ".join(rng.choice(["Alpha", "beta", "gamma", "é😀", "x\ny", "z"]) + str(rng.randrange(40)) for _ in range(rng.choice([0, 1, 3, 5, 40, 300])))) for i in range(120)]
    rows += [(9991, rows[3][1]), (None, "null id here five words long"), (100001, None), (100000, ""), (200000, "word " * 4000)]
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for doc, (n, sha, edited, after) in want.items():
        assert (got[doc].n_chars, got[doc].edited_sha256) == (n, sha)
        assert got[doc].near_edited == pytest.approx(edited, abs=0.2) and got[doc].near_next == pytest.approx(after, abs=0.2)
        if n < 500:
            assert got[doc].near_edited == pytest.approx(edited)
    assert got[9991].fingerprint == got[rows[3][0]].fingerprint
    assert got[100000].fingerprint == "" and got[100001].near_next == 1.0


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert fp.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = fp.fingerprints(spark.createDataFrame([(4, "a b c d e f")], schema)).first()
    assert one.near_next == 1.0 and one.n_chars == 11
    assert fp.fingerprints(spark.createDataFrame([(4, "a b")] * 3 + [(None, "c")] * 2, schema)).count() == 5


def test_sketches_merge(spark):
    a, b = " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(600, 1500))
    row = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string").select(
        (fp.merged(fp.sketch(F.col("a")), fp.sketch(F.col("b"))) == fp.sketch(F.col("c"))).alias("same"), fp.distinct_estimate(fp.sketch(F.col("a"))).alias("n"), fp.containment(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("inside")
    ).first()
    assert row.n == pytest.approx(896, rel=0.3) and row.inside == pytest.approx(1 / 3, abs=0.15)


def test_hot_ids_and_texts_have_several_blocks(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    rows = [(None, f"null id with words {i % 300}") for i in range(1500)] + [(7, f"seven has many rows {i}") for i in range(1500)] + [(8, "the same row again and again")] * 6000
    rows += [(i, f"a row of its own {i}") for i in range(100, 400)] + [(least, "least id of all ids here"), (most, "largest id of all ids here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = fp.with_next(docs).where("ahead = 0").groupBy("block").count().collect()
    assert sum(r["count"] for r in placed) == len(rows) and max(r["count"] for r in placed) < 2500
    ties = {t: h for t, h in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string").select("text", fp.tie_of(F.col("text"))).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), ties[r[1]]))
    want = Counter()
    for i, (doc, text) in enumerate(ordered):
        cut = len(text) // 2
        want[doc, hashlib.sha256((text[: len(text) - cut] + ordered[(i + 1) % len(rows)][1][:cut]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in fp.fingerprints(docs).select("doc_id", "edited_sha256").collect()) == want


def test_sketch_of_a_table(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i + k}" for k in range(40)),) for i in range(0, 400, 7)] + [(None,)], "text string")
    everything = sorted({h for r in docs.select(fp.shingle_hashes(F.coalesce("text", F.lit(""))).alias("h")).collect() for h in r.h})
    assert fp.table_sketch(docs.repartition(6)).first().sketch == everything[: fp.K] == fp.table_sketch(docs.coalesce(1)).first().sketch
    assert fp.table_sketch(docs.limit(0)).first().sketch == []
