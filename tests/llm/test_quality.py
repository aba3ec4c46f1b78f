import zlib

import numpy as np
import pyarrow as pa

from gridloom.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_columns(spark):
    got = quality.op9_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == 10000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out, strict=True))
    own = got.merge(labels, on="doc_id")
    own = own[own.held_out]
    assert (own.predicted == own.quality).mean() > 0.97
    assert ((own.predicted == 0) & (own.quality == 1)).sum() <= 0.01 * len(own)


def test_labels_held_out_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "good word here" if i % 2 else "bad$$$ word%%%") for i in range(300)] + [(None, None), (1, ""), (1, "")], "doc_id long, text string").withColumn("score", quality.F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (4, None)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    one, two = (sorted(map(str, quality.score(docs, x).select("doc_id", "score", "predicted").collect())) for x in (labels, flipped))
    assert one == two and len(one) == 303
    assert quality.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_vectors_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"the {i} word%% is {i * i}") for i in range(200)], "doc_id long, text string")
    assert np.array_equal(quality.word_vectors(docs.repartition(7)), quality.word_vectors(docs.coalesce(1)))
    vectors = quality.word_vectors(docs)
    pair = quality.pooled(pa.array(["a b%%", None, "x " * 100000]), vectors)
    assert np.allclose(pair[0], quality.pooled(pa.array(["a b%%"]), vectors)[0], atol=1e-6) and not pair[1].any()


def test_scores_match_a_plain_forward_pass(spark):
    """Pooling and network again, unit by unit in plain Python."""
    import math
    import re

    texts = ["the cat sat on the mat", "a%% b%% 12ab c$$$ the the", "", "é中 x" * 40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 30)], "doc_id long, text string")
    vectors = quality.word_vectors(docs)
    rng = np.random.default_rng(1)
    x = quality.pooled(pa.array([texts[i % 4] for i in range(200)]), vectors) + rng.normal(size=(200, 2 * quality.DIM + 5)) * 0.01
    net = quality.Network(x.astype(float), (rng.random(200) < 0.5).astype(float), epochs=3)
    got = net.score(quality.pooled(pa.array(texts), vectors).astype(float))
    for text, score in zip(texts, got, strict=True):
        words = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff \t-\r]+", text.encode())
        ids = [int(quality.units(pa.array([w.decode(errors="surrogateescape")]))[0][0]) for w in words]
        mean = [sum(float(vectors[i][d]) for i in ids) / max(1, len(ids)) for d in range(2 * quality.DIM)]
        norms = [math.sqrt(sum(v * v for v in mean[a : a + quality.DIM])) for a in (0, quality.DIM)]
        again = [sum(ids[i] == ids[i + gap] for i in range(len(ids) - gap)) / max(1, len(ids)) for gap in (1, 2)]
        z = [(v - m) / s for v, m, s in zip([*mean, *norms, *again, math.log1p(len(ids))], net.mean, net.scale, strict=True)]
        hidden = [math.tanh(sum(v * w for v, w in zip(z, column, strict=True)) + b) for column, b in zip(net.w[0].T, net.w[1], strict=True)]
        logit = sum(h * w for h, w in zip(hidden, net.w[2], strict=True)) + net.w[3][0]
        assert abs(score - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-4


def test_context_vectors_match_a_plain_count(spark):
    texts = ["a b c a%% d", "b a", None, "c " * 9]
    vectors = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        ids = quality.units(pa.array([t], pa.string()))[0]
        for i, own in enumerate(ids):
            for j in range(max(0, i - quality.SPAN), min(len(ids), i + quality.SPAN + 1)):
                if j != i:
                    want[own] += vectors[ids[j]]
    want /= np.maximum(np.sqrt((want**2).sum(1)), 1e-9)[:, None]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(got[:, : quality.DIM], want, atol=1e-6)


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(i, "good word here" if i % 2 else "bad$$$ word%%%") for i in range(200)] + [(1, "good word here")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 700 and all(r.predicted == r.doc_id % 2 for r in got)
