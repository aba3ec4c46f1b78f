import random
import re

from gridloom.llm import graph, minhash


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)]) if words else frozenset()


def brute(rows, width=4):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [(len(sets[i]), min((rows[j][0] for j in range(len(rows)) if find(j) == find(i)))) for i in range(len(rows))]


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd ef gh ij kl Mn é😀 op".split()) + str(rng.randrange(60))
    texts = [" ".join(word() for _ in range(rng.choice([3, 8, 40, 90, 200]))) for _ in range(60)]
    for base in range(25):
        words = texts[base].split()
        for edits in (0, 1, 1, 2, 3, 5):
            copy = list(words)
            for _ in range(min(edits, len(copy))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(200)]
    for _ in range(60):
        chain[rng.randrange(200)] = word()
        texts.append("\n".join(chain))
    texts += ["", None, "  \n", "one", "ONE", "a b c d e"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    want = {d: w for (d, t), w in zip(rows, brute(rows), strict=True)}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_stays_and_empty_tables(spark):
    rows = [(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "x"), (2, "A b c d e f g h", "y"), (3, None, "z"), (4, "", "z"), (None, "q r s t u v", "n"), (5, "q r s t u v", "n"), (None, "one two three four five six", "p"), (None, "seven eight nine ten eleven", "q"), (None, "seven eight nine ten eleven", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_id string")
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.set_id) for r in left.collect()) == [(0, "p"), (0, "q"), (1, "x"), (3, "z"), (4, "z"), (5, "n")]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_graphs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 5), (3, 3), (None, 4)] + [(1000, 2000 + i) for i in range(50)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 9: 5, 7: 5, 1000: 1000} | {2000 + i: 1000 for i in range(50)}


def thue_morse(size, start):
    return "".join("ab"[(bin(i).count("1") + start) % 2] for i in range(size))


def test_hashes_alone_link_nothing(spark, monkeypatch):
    rows = [(1, thue_morse(2048, 0)), (2, thue_morse(2048, 1)), (3, thue_morse(1024, 0)), (4, thue_morse(1024, 1))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4}
    exact = minhash._Exact(2, 0.8)
    assert exact.linked(1, b"a b c", 2, b"a b c b c") is False and exact.linked(3, b"a b c", 4, b"a b c") is True
    import pandas as pd

    sets = [minhash._hashed([b"a b c d e"], 2)[0]] * 2
    monkeypatch.setattr(minhash, "_hashed", lambda words, width: [sets[0]] * len(words))
    star = pd.DataFrame({"b": 1, "chunk": 0, "node": [1, 2, 3], "center": [True, False, False], "words": [b"a b c d e", b"a b c d e", b"x y z u v"]})
    assert minhash._star(2, 0.8)(star).to_numpy().tolist() == [[2, 1]]
    zone = pd.DataFrame({"zone": 0, "part": [1, 1, 2, 3], "node": [1, 1, 2, 3], "mover": [True, False, False, False], "words": [b"a b c d e", b"a b c d e", b"a b c d e", b"x y z u v"]})
    assert minhash._joining(2, 0.8)(zone).to_numpy().tolist() == [[1, 2]]


def test_many_mutually_alike_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHINGLES", 3000)  # several blocks of several tasks
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(8)
    common = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*common, *(f"x{i}y{j}" for j in range(20))])) for i in range(60)]
    rows += [(100 + i, " ".join([*common, *(f"x{i}y{j}" for j in range(18)), "z z"])) for i in range(0, 60, 7)]
    rng.shuffle(rows)
    want = {d: w for (d, _), w in zip(rows, brute(rows), strict=True)}
    assert len({w for _, w in want.values()}) == 60
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_rows_with_columns_of_the_operators_names(spark):
    rows = [(1, "a b c d e f", "kept", "p", 7), (2, "a b c d e f", "gone", "q", 8), (2, "u v w x y z", "own", "r", 9), (None, "u v w x y z", "gone", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_hash string, part string, hash long")
    assert sorted(map(tuple, minhash.without_near_duplicates(docs).collect())) == [(1, "a b c d e f", "kept", "p", 7), (2, "u v w x y z", "own", "r", 9)]
