import bisect
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import packing

SF = "/root/testdata/sf0.01"
FILES = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    found.encode_special_tokens = True
    return found


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def check(rows, docs, library, capacity):
    """Every piece of every document is there once and right, and sequences are gapless and never too long."""
    want = {}
    for i, text in docs:
        ids = np.array([*ids_of(library, text), packing.END], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            key = (i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r.length for r in rows)


def best_fit_decreasing(counts):
    capacity, room, out = len(counts) - 1, [], 0
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            i = bisect.bisect_left(room, length)
            if i == len(room):
                out += 1
                left = capacity - length
            else:
                left = room.pop(i) - length
            bisect.insort(room, left)
    return out


def test_pieces_places_and_edge_rows(spark, library):
    rng = random.Random(3)
    words = ["alpha", "x", "Ünï", "12", "<|endoftext|>", "\n", "漢字", "don't", "  "]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(150)]
    docs += [(None, "a b"), (None, None), (7, ""), (7, ""), (8, "same text"), (8, "same text"), (9, "long words " * 3000), (10, "b" * 20_000), (11, " " * 3000 + "x"), (12, "퟿\x00")]
    docs += [(200 + k, "a hot row of many copies") for k in range(300)]
    table = spark.createDataFrame([(*d, "l", 1) for d in docs], "doc_id long, text string, length string, rank int").repartition(5)
    for capacity in (16, 64):
        rows = packing.pack(table, capacity).collect()
        used, tokens = check(rows, docs, library, capacity)
        assert used <= math.ceil(tokens / capacity) * 1.1 + 1
    assert packing.pack(table.limit(0)).collect() == []


def test_whole_table_needs_few_sequences(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = packing.op12_packing(spark, SF)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    used, tokens = check(df.collect(), docs, library, packing.CAPACITY)
    assert used <= math.ceil(tokens / packing.CAPACITY) + 1


@settings(max_examples=60, deadline=None)
@given(st.text(st.one_of(st.characters(), st.sampled_from(" \n\t'a1　\x85")), max_size=300))
def test_ids_are_those_of_the_library(text):
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    library.encode_special_tokens = True
    text = text.encode("utf-8", "replace").decode()
    assert packing.encode(text, packing.encoder(*FILES)).tolist() == ids_of(library, text)


def test_chunks_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(packing, "_CHUNK", 50)
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "1", "é", "　", "!", " \n x"]) for _ in range(400))
        assert packing.encode(text, packing.encoder(*FILES)).tolist() == ids_of(library, text)
    text = "word\n" + " " * 5000 + "\t\n" * 800 + "end"
    assert packing.encode(text, packing.encoder(*FILES)).tolist() == ids_of(library, text)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.data())
def test_plans_hold_every_piece_and_beat_or_match_best_fit(capacity, data):
    counts = np.array([0, *data.draw(st.lists(st.integers(0, 30), min_size=capacity, max_size=capacity))])
    planned, bound = packing.plan(counts)
    held = np.zeros(capacity + 1, np.int64)
    for found, times in planned:
        assert times > 0 and sum(k * n for k, n in found.items()) <= capacity
        for k, n in found.items():
            held[k] += n * times
    assert (held == counts).all()
    used = sum(times for _, times in planned)
    assert bound <= used + 1e-6 and used <= best_fit_decreasing(counts) * 1.05 + 1
    rows = packing.ranges(planned)
    for length in np.flatnonzero(counts):
        own = rows[rows[:, 0] == length]
        assert own[0, 1] == 0 and (np.diff(own[:, 1]) > 0).all()


def test_the_cover_nears_the_linear_program():
    rng = np.random.default_rng(1)
    counts = np.zeros(257, np.int64)
    for length in rng.integers(1, 257, 4000):
        counts[length] += 1
    x, bound = packing.configurations(counts, 2000, 16, 1.0, 8.0)
    covered = np.zeros(257)
    for found, times in x.items():
        for k, n in found:
            covered[k] += n * times
    least = (covered[counts > 0] / counts[counts > 0]).min()
    assert least >= 8 and sum(x.values()) / least <= 1.1 * bound
