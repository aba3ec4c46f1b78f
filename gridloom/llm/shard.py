"""Sharding by histogram sort: exact bytes below probe keys, probes refined from real keys, one exchange.

The key of a row is the hash of its text, then its id, then its place in the input, as 24 bytes: equal texts stand
together, and a hot text is still split between shards where the law (sizes near equal) needs it. A null text has
no bytes and stands with the empty ones; a null id comes first among equal texts. Repeated rows are rows of their
own. Texts of any length count whole. An empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import materialize, mix64, read_table

KEY = "S24"
SHARDS = 24
#: Of a shard's bytes, how far its border may be off; a border inside a shard, which only spreads work, may be further off.
TOLERANCE, INNER_TOLERANCE = 0.0005, 0.02
#: Real keys drawn between two probes for each border sought there.
PROBES = 8


def _keys(column) -> np.ndarray:
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[column.offset * 24 : (column.offset + len(column)) * 24].view(KEY) if len(column) else np.zeros(0, KEY)


def _count(keyed: DataFrame, probes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows in each of the gaps before, between and after the sorted probes."""

    def histogram(batches):
        edges = np.array(probes, KEY)
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            gap = np.searchsorted(edges, _keys(batch.column(0)), "right")
            np.add.at(size, gap, batch.column(1).to_numpy())
            np.add.at(rows, gap, 1)
        import pyarrow as pa

        seen = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(size[seen]), pa.array(rows[seen])], ["gap", "size", "rows"])

    counted = keyed.select("key", "size").mapInArrow(histogram, "gap long, size long, rows long").groupBy("gap").agg(F.sum("size"), F.sum("rows"))
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for gap, s, n in counted.collect():
        size[gap], rows[gap] = s, n
    return size, rows


def _draw(keyed: DataFrame, probes: list[bytes], wanted: dict[int, int]) -> list[bytes]:
    """For every open gap that many keys that lie in it, by least hash, so any partitioning draws the same."""

    def choose(batches):
        edges = np.array(probes, KEY)
        slots = np.zeros(len(edges) + 1, np.int64)
        for gap, n in wanted.items():
            slots[gap] = n
        best: dict[tuple[int, int], tuple[int, bytes]] = {}
        for batch in batches:
            keys = _keys(batch.column(0))
            gap = np.searchsorted(edges, keys, "right")
            inside = (slots[gap] > 0) & ((gap == 0) | (keys != edges[np.maximum(gap - 1, 0)] if len(edges) else True))
            keys, gap = keys[inside], gap[inside]
            if not len(keys):
                continue
            parts = np.frombuffer(keys.tobytes(), ">u8").reshape(-1, 3).astype(np.uint64)
            luck = mix64(parts[:, 0] ^ mix64(parts[:, 1] ^ mix64(parts[:, 2])))
            slot = (luck % slots[gap].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((luck, slot, gap))
            g, s = gap[order], slot[order]
            for i in order[np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])])]:
                at, found = (int(gap[i]), int(slot[i])), (int(luck[i]), keys[i].ljust(24, b"\0"))
                best[at] = min(best.get(at, found), found)
        import pyarrow as pa

        rows = [(g, s, luck - (1 << 63), key) for (g, s), (luck, key) in best.items()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["gap", "slot", "luck", "key"])

    drawn = keyed.select("key").mapInArrow(choose, "gap long, slot long, luck long, key binary")
    return [bytes(r[0]) for r in drawn.groupBy("gap", "slot").agg(F.min_by("key", "luck").alias("key")).select("key").collect()]


def split(keyed: DataFrame, borders: list[float], slack: list[float]) -> tuple[list[bytes], list[int]]:
    """Keys below which the bytes come within slack of each border (or as near as whole rows allow), and the rows below each."""
    probes: list[bytes] = []
    size, rows = _count(keyed, probes)
    while True:
        below, under = np.cumsum(size)[:-1], np.cumsum(rows)[:-1]  # of probe i: in gaps 0 .. i
        chosen, wanted = [], {}
        for border, most in zip(borders, slack, strict=True):
            i = bisect_left(below, border)
            near = min((j for j in (i - 1, i) if 0 <= j < len(probes)), key=lambda j: abs(below[j] - border), default=-1)
            chosen.append(near)
            if (near < 0 or abs(below[near] - border) > most) and rows[i] > (1 if i else 0):
                wanted[i] = wanted.get(i, 0) + PROBES
        fresh = sorted(set(_draw(keyed, probes, wanted)) - set(probes)) if wanted else []
        if not fresh:
            return [probes[j] for j in chosen if j >= 0], [int(under[j]) for j in chosen if j >= 0]
        useful = {j for b in borders for i in (bisect_left(below, b),) for j in (i - 1, i) if 0 <= j < len(probes)}
        probes = sorted({*fresh, *(probes[j] for j in useful)})
        size, rows = _count(keyed, probes)


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    word = lambda x: F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.concat(word(F.xxhash64(text)), word(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))), word(F.monotonically_increasing_id())))
    keyed = materialize(docs.select(key.alias("key"), "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    total = keyed.agg(F.sum("size")).first()[0] or 0
    fine = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    borders = [total * i / (shards * fine) for i in range(1, shards * fine)]
    slack = [total / shards * (INNER_TOLERANCE if i % fine else TOLERANCE) for i in range(1, shards * fine)]
    splitters, under = split(keyed, borders, slack) if total else ([], [])
    under = [0, *under] if splitters else [0]
    bases = [under[i] - under[i - i % fine] for i in range(len(under))]

    def place(batches):
        import pyarrow as pa

        edges = np.array(splitters, KEY)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(edges, _keys(batch.column(0)), "right"))], [*batch.schema.names, "bucket"])

    dealt = keyed.mapInArrow(place, "key binary, doc_id long, size long, text_crc32 long, bucket long")
    base = F.element_at(F.transform(F.split(F.lit(",".join(map(str, bases))), ","), lambda x: x.cast("bigint")), (F.col("bucket") + 1).cast("int"))
    slot = base + F.row_number().over(Window.partitionBy("bucket").orderBy("key")) - 1
    return dealt.select("doc_id", "size", "text_crc32", F.floor(F.col("bucket") / fine).cast("int").alias("shard"), slot.alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
