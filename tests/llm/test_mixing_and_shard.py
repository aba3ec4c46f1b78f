import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing, shard

SF = "/root/testdata/sf0.001"


def test_mixture_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(mixing.OP7_SQL).fetchall())
    got = sorted(map(tuple, mixing.op7_mixing(spark, SF).collect()))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] is None for x in got] == [x[5] is None for x in want] and any(x[5] is None for x in got)
    assert [x[5] for x in got if x[5] is not None] == pytest.approx([x[5] for x in want if x[5] is not None], abs=1e-12)


def test_targets_and_nulls(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 10 else None) for i in range(400)] + [(None, None, None), (None, "x y", "a"), (7, "", "b"), (7, "", "b"), (900, "z " * 5000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    mixed = mixing.mix(docs)
    got = mixed.collect()
    assert len(got) == len(rows)
    for name in {r.source for r in got}:
        own = [r for r in got if r.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert own[0].source_size == sum(r["size"] for r in own) and own[0].target <= 2 * own[0].source_size + 1e-9
    assert all(0 <= r.taken <= 2 * r["size"] and all(0 <= p < 1 for p in r.positions) for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))


def test_hot_ids_and_columns_of_the_operators_names(spark):
    rows = [(None, f"one two {i % 40}", "a", "s", "p", 1.5, "o") for i in range(500)] + [(7, "same row of it", "b", "s", "p", 2.5, "o")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slope string, part string, target double, row string").repartition(6)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all((r.slope, r.part, r.row) == ("s", "p", "o") for r in got)
    for name in "ab":
        own = [r for r in got if r.source == name]
        starts = sorted(p for r in own for p in r.positions)
        assert len(set(starts)) == len(starts) and abs(sum(r.taken for r in own) - own[0].target) <= 1
    taken = mixing.taken_documents(docs).collect()
    assert all((r.slope, r.part, r.row, r.target) == ("s", "p", "o", {"a": 1.5, "b": 2.5}[r.source]) for r in taken) and len(taken) > 700


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_are_even_and_slots_gapless(spark, shards):
    rows = [(i, f"text {i} " * (i % 50)) for i in range(800)] + [(i, "the same hot text") for i in range(800, 1600)] + [(5, "x"), (5, "x"), (None, None), (None, ""), (-3, "é" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = shard.shard_by_bytes(docs, shards).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    loads = {}
    for r in got:
        loads.setdefault(r.shard, []).append(r)
    total = sum(r["size"] for r in got)
    for own in loads.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert set(loads) <= set(range(shards))
    if shards == 3:
        assert all(abs(sum(r["size"] for r in own) - total / 3) <= 6100 for own in loads.values())


def test_law_on_whole_tables(spark):
    """Loads of 24 shards, by brute force over the rows' own order: each border is as near as the tolerance or whole rows allow."""
    for folder in (SF, SF.replace("0.001", "0.01")):
        got = shard.op2_sharding(spark, folder).collect()
        loads = [0] * 24
        for r in got:
            loads[r.shard] += r["size"]
        total, most = sum(loads), max(r["size"] for r in got)
        ends = [sum(loads[: k + 1]) for k in range(23)]
        slack = [max(shard.TOLERANCE * total / 24, most / 2) for _ in ends]
        assert all(abs(end - total * (k + 1) / 24) <= s for k, (end, s) in enumerate(zip(ends, slack, strict=True)))
        assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_empty_and_single(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shard.shard_by_bytes(docs).count() == 0 and shard.shard_by_bytes(docs).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert shard.shard_by_bytes(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 1
