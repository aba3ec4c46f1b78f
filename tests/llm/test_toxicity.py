import zlib

import numpy as np
import pyarrow as pa

from gridloom.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    words = tox.Words(pa.array(["the idiot is here é and Gone", "", "one " * 70]))
    ids, _ = words.windows()
    net = tox.Network(kind=np.float64)
    y = np.linspace(0, 1, len(ids))

    def loss():
        x = net.inputs(words.words, words.grams)
        logit, _ = net.forward(ids, net.project(x))
        return (np.logaddexp(0, logit) - y * logit).sum()

    x = net.inputs(words.words, words.grams)
    logit, held = net.forward(ids, net.project(x), True)
    grads = net.backward(tox._sigmoid(logit) - y, x, words.words, words.grams, held)
    for name, value in net.p.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        before = value[at]
        value[at] = before + 1e-5
        up = loss()
        value[at] = before - 1e-5
        down = loss()
        value[at] = before
        assert np.isclose((up - down) / 2e-5, grads[name][at], rtol=1e-4, atol=1e-7), name


def test_windows_cover_every_word():
    texts = pa.array([" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 63, 64, 65, 96, 97, 1000)])
    words = tox.Words(texts)
    ids, row = words.windows()
    for r in range(len(texts)):
        seen = set(ids[row == r].ravel()) - {len(words.words)}
        assert seen == set(words.ids[words.at[r] : words.at[r + 1]])


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = tox.score(docs.join(labels.select("doc_id"), "doc_id"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out, strict=True))
    own = got[got.held_out]
    assert (own.predicted == own.toxic).mean() > 0.95
    assert ((own.predicted == 1) & (own.toxic == 0)).mean() < 0.03


def test_small_tables(spark):
    rows = [(i, "you idiot there" if i % 3 == 0 else "a calm day") for i in range(90)] + [(None, None), (1, ""), (1, ""), (500, "calm " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", tox.F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = tox.score(docs, labels).collect()
    assert len(got) == 94 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.predicted for r in got if r.text == "you idiot there"} == {1} and {r.predicted for r in got if r.text == "a calm day"} == {0}
    assert tox.score(docs.limit(0), labels).count() == 0
    assert len({r.score for r in tox.score(docs, labels.limit(0)).collect()}) == 1


def test_every_byte_of_long_runs_is_read():
    texts = ["short", "x" * 12, "donaudampfschifffahrtsgesellschaft", "\u4f60\u662f\u50bb\u74dc\u3002" * 40, "a\u00e9" * 33, "\U0001f600" * 9]
    for text in texts:
        raw = text.encode()
        a, b = tox._units(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
        assert (b - a).max() <= tox.UNIT + 6 and a[0] == 0 and b[-1] == len(raw)
        for i in range(len(raw) - tox.INNER + 1):
            assert ((a <= i) & (b >= i + tox.INNER)).any()
        for s, e in zip(a, b, strict=True):
            raw[s:e].decode()
    words = tox.Words(pa.array(texts[2:4]))
    assert (np.diff(words.at) > 4).all()


def test_toxic_words_inside_runs_are_found():
    clean, bad = ["a calm day", "some quiet words", "the long river"], "you idiot there"
    texts = [bad if i % 3 == 0 else clean[i % 3] for i in range(300)]
    scorer = tox.Scorer(pa.array(texts), np.array([float(i % 3 == 0) for i in range(300)]), (0.7, 0.3))
    inside, without = scorer.score(pa.array(["calmquietriverwordsidiotlongcalmquietday", "calmquietriverwordsriverlongcalmquietday"]))
    assert inside > without + 0.2


def test_scores_match_a_plain_forward_pass():
    """Every window's logit again, word by word in plain Python."""
    import math

    words = tox.Words(pa.array(["the quick fox and The fox é12", "one two " * 50, ""]))
    net = tox.Network(seed=9, kind=np.float64)
    logits, _ = net.logits(words)
    ids, _ = words.windows()
    sig = lambda v: 1 / (1 + math.exp(-v))
    h = tox.HIDDEN
    for window, want in zip(ids, logits, strict=True):
        own = [int(i) for i in window if i < len(words.words)]
        x = [np.r_[net.p["word"][words.words[i]], sum(net.p["char"][g] for g in words.grams[i])] for i in own]
        states = [[], []]
        for k in (0, 1):
            state = [0.0] * h
            for v in x if k == 0 else x[::-1]:
                gate = [sum(a * b for a, b in zip(v, column, strict=True)) + o for column, o in zip(net.p[f"in{k}"].T, net.p[f"off{k}"], strict=True)]
                turn = [sum(a * b for a, b in zip(state, column, strict=True)) for column in net.p[f"rec{k}"].T]
                z, r = [sig(gate[d] + turn[d]) for d in range(h)], [sig(gate[h + d] + turn[h + d]) for d in range(h)]
                new = [math.tanh(gate[2 * h + d] + r[d] * turn[2 * h + d]) for d in range(h)]
                state = [(1 - z[d]) * new[d] + z[d] * state[d] for d in range(h)]
                states[k].append(state)
        both = [a + b for a, b in zip(states[0], states[1][::-1], strict=True)]
        look = [math.exp(sum(a * b for a, b in zip(s, net.p["look"], strict=True))) for s in both]
        pooled = [sum(w * s[d] for w, s in zip(look, both, strict=True)) / sum(look) for d in range(2 * h)] if both else [0.0] * (2 * h)
        assert abs(sum(a * b for a, b in zip(pooled, net.p["out"], strict=True)) + net.p["bias"][0] - want) < 1e-6


def test_learning_takes_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(tox, "LEARNED", 3000)
    rows = [(i, "you idiot there" if i % 3 == 0 else "a calm day") for i in range(300)] + [(1, "a calm day")] * 400 + [(2, "a calm day " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(tox, "Scorer", lambda texts, y, shares: seen.append((texts, y)))
    tox.train(docs, labels)
    texts, y = seen[0]
    assert 0 < sum(len(t.as_py()) for t in texts) <= 3000 and len(y) == len(texts) and set(y) == {0.0, 1.0}
