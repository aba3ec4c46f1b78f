import hashlib
import re
import zlib

import pytest

from gridloom.llm import prefix_trie


def brute(rows, every=20, lent=4):
    """The trie of rebuilt conversations as a dictionary of paths."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        own.setdefault(c, []).append((role or "", text or ""))
    paths = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % lent if every else 0
        base = own.get(c - (abs(c) % every) * (1 if c >= 0 else -1), []) if every else []
        paths[c] = tuple(base[:h] + found[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words(p)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(paths[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def rows_of(df):
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in df.collect())


CONVERSATIONS = [
    *[(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 3} of kind {c % 4 if t > 1 else 0}") for c in range(70) for t in range(c % 6)],
    *[(c, t, "user", "the same") for c in range(200, 240) for t in range(4)],
    (300, None, None, None), (300, None, "user", None), (300, 5, "a", "b c"), (300, 5, "a", "b c"), (300, 5, "a", "a c"), (300, 5, None, "z"), (None, 0, "user", "lost"),
    (-3, 0, "u", "x y"), (-41, 0, "u", "x y"), (-41, 1, "u", "x y"), (341, 0, "ab", "c"), (342, 0, "a", "bc"), (343, 7, "user", ""), (10**12, 0, "user", "one two"),
]


@pytest.mark.parametrize("every", [20, 0])
def test_nodes_against_a_dictionary_of_paths(spark, every):
    table = spark.createDataFrame([(*r, 1, "s") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, depth int, s0 string").repartition(5)
    got = prefix_trie.trie(table, prefix_trie.sharing() if every else prefix_trie.as_they_are)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert rows_of(got) == brute(CONVERSATIONS, every)


def test_a_conversation_over_many_parts_and_a_hot_first_turn(spark):
    rows = [(7, k // 3, "user", f"w {k % 2}") for k in range(900)] + [(20 * k + 400, t, "user", ["hot", f"only {k}"][t]) for k in range(300) for t in range(2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(prefix_trie.trie(table, prefix_trie.sharing())) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_tables_and_turnless_conversations(spark):
    table = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(table.limit(0), prefix_trie.sharing()).count() == 0
    assert prefix_trie.trie(table.where("conv_id is null")).count() == 0
    # crc32("1") % 4 = 3 turns of an absent base take the place of its own
    lone = spark.createDataFrame([(1, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    assert rows_of(prefix_trie.trie(lone, prefix_trie.sharing())) == brute([(1, 0, "u", "a")]) and zlib.crc32(b"1") % 4 == 3
