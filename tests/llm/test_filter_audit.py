import re
from collections import Counter
from itertools import permutations

import pytest

from gridloom.llm import filter_audit


def brute(docs, labels):
    """The rows of the audit, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    texts = [(i, t or "", p or "") for i, t, p in docs]
    out = {}
    for i, t, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": i is not None and any(j is not None and j < i and s == t for j, s, _ in texts),
        }
        failed = {k for k, v in tests.items() if v}
        for order in permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                c = out.setdefault((part, "".join(order), step), Counter())
                gone = bool(failed & set(order[: step - 1]))
                c["kept"] += not gone and own not in failed
                c["removed"] += not gone and own in failed
                c["redundant"] += gone and own in failed
                c["unique_fails"] += failed == {own}
                c["good_lost"] += not gone and own in failed and i in good
                c["toxic_lost"] += not gone and own in failed and i in bad
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*k, *[c[n] for n in names], shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items())


DOCS = [
    (1, "a b c", "en"), (2, "a b c", "en"), (2, "a b c", "en"), (3, None, None), (4, "", "de"), (5, "", None), (None, "", "en"), (None, "a b c", "en"),
    (6, "word " * 500, "en"), (7, " ".join(f"w{k}" for k in range(300)), "de"), (8, " ".join(f"W{k}" for k in range(300)), "de"), (8, " ".join(f"w{k}" for k in range(300)), ""),
    (9, "x$y \x0b\x1c", "fr"), (10, "\t\n " * 50, "fr"), (11, "é" * 40 + "A", "fr"), (12, "AB" + "é" * 40, "fr"), (-1, "a b c", "xx"), (13, "w" * 100_000 + " |" * 3000, "xx"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, 0, 1), (8, 1, 1), (None, 1, 1), (7, None, None), (99, 1, 1)]


@pytest.mark.parametrize("copies", [1, 40])
def test_every_order_against_counting_document_by_document(spark, copies):
    rows = DOCS + [(100 + k, "a b c", "en") for k in range(copies)] + [(7, DOCS[9][1], "de")] * copies
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, mask int, key string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality long, toxic long")
    got = filter_audit.audit(docs, labels)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
    assert sorted(map(tuple, got.collect())) == brute(rows, LABELS)


def test_empty_tables_and_sums(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality long, toxic long")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    got = filter_audit.audit(docs, labels.limit(0)).collect()
    assert not any(r.good_lost or r.toxic_lost for r in got)
    for part in {r.part for r in got}:
        last = {r.filter_order: r for r in got if r.part == part and r.step == 5}
        assert len(last) == 120 and len({r.kept for r in last.values()}) == 1
        values = {r.filter_order[r.step - 1]: r.shapley for r in got if r.part == part}
        n = sum(p == part for p in ((x[2] or "") for x in DOCS))
        assert sum(values.values()) == 120 * (n - last["ABCDE"].kept)
