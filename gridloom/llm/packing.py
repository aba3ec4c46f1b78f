"""Best-fit packing: documents' token pieces into as few sequences of fixed capacity as can be.

1. Every text becomes ids and the end id 0; a document longer than the capacity is cut into whole sequences from its end
   on, so only its first piece may be shorter. A task counts its pieces of each length as it goes, so a piece's rank among
   those of its length is that count plus the counts of the tasks before: no length is ever sorted or gathered.
2. The histogram of lengths (at most `capacity` numbers, however many documents) goes to the driver. A configuration is a
   multiset of lengths that fits a sequence. The configuration linear program, min sum x_p with every length covered, is
   solved by multiplicative weights: a length's price is its size, discounted by e to the power of its coverage; the knapsack
   dynamic program finds the dearest configuration of a length with others; it is taken until one of its lengths is
   covered once more. The loop ends when
   all lengths are covered `LEVELS` times; the mean of these covers is the solution.
3. A configuration's number is divided by the largest coverage among its lengths, so that together they use no length up
   more than once, and rounded down; what is left is packed largest first, the rest of the
   sequence filled as full as what is left allows (an exact subset sum). Every length's pieces are then ranges of
   (configuration, copy, place), and a rank finds its own by binary search in that table, whose size the capacity bounds.

The rounding leaves no piece out and no sequence above its capacity; how near it comes to the lower bound (tokens over
capacity) is tested.

ids are those of the `tokenizers` file; they are computed by tiktoken on the same vocabulary, which is several times faster
and held against it in tests. White space of 1000 signs and more goes through `tokenizers`, since the other's pattern
recurses there. Strings of special tokens in a text are ordinary text. Texts are encoded in chunks of about a million
signs, cut before a blank that follows a letter, where no token can span.

Nulls: a null text is empty and makes one piece, the end id alone; a null doc_id is kept. Repeated rows are pieces of their
own. Texts of any length count whole (their ids are held by one task, four bytes each). An empty table gives an empty one.
Further columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from gridloom.llm.common import materialize, read_table, small_batches, tidy

CAPACITY = 2048
END = 0
#: Rounds of pricing at most, configurations taken a round, and how fast a covered length gets cheaper.
ROUNDS, BLOCK, RATE = 200, 64, 2.0
#: How often every length is covered; the more often, the nearer the mean cover comes to the optimum.
LEVELS = 4.0
_CHUNK = 1 << 20
_BLANKS = re.compile(r"\s{1000,}")
_CUT = re.compile(r"(?<=[A-Za-z])[ \n]")


@functools.cache
def encoder(model: str, ranks: str):
    """text -> list of ids, by the files of these two names; built once a process."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks)) as file:
        table = {base64.b64decode(a): int(b) for a, b in map(str.split, file)}
    fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @functools.cache
    def slow() -> Tokenizer:
        made = Tokenizer.from_file(public_tokenizers.path(model))
        made.encode_special_tokens = True
        return made

    def part(text: str) -> list[int]:
        if _BLANKS.search(text):
            return slow().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return part


def encode(text: str, part) -> np.ndarray:
    """ids of a whole text, chunk by chunk."""
    out, at = [], 0
    while len(text) - at > _CHUNK:
        cut = _CUT.search(text, at + _CHUNK)
        if cut is None:
            break
        out.append(np.array(part(text[at : cut.start()]), "<u4"))
        at = cut.start()
    out.append(np.array(part(text[at:]), "<u4"))
    return np.concatenate(out)


def pieces(docs: DataFrame, capacity: int = CAPACITY, model: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """docs (doc_id, text): doc_id, piece, start, length, ids_crc32, and the task and the piece's rank in it among its length."""
    named = [("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType()), ("task", IntegerType()), ("rank", LongType())]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, task = encoder(model, ranks), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in small_batches(batches, "text"):
            owner, rows = [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or "", part), np.uint32(END)).astype("<u4")
                bounds = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    owner.append(k)
                    rows.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a]))
                    seen[b - a] += 1
            columns = zip(*rows, strict=True) if rows else [[] for _ in named]
            types = (pa.int32() if isinstance(t, IntegerType) else pa.int64() for _, t in named)
            made = [pa.array(np.array(c, np.int64)).cast(t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *made], [batch.schema.names[0], *(n for n, _ in named)])

    read = docs.select("doc_id", "text")
    return read.mapInArrow(run, StructType([read.schema["doc_id"], *(StructField(n, t) for n, t in named)]))


# --- the histogram's packing, on the driver


class Prices:
    """Dearest multiset of lengths for every room up to the capacity; among equally dear ones that of the largest lengths."""

    def __init__(self, price: np.ndarray, lengths: np.ndarray) -> None:
        capacity = len(price) - 1
        self.value, self.last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        for room in range(1, capacity + 1):
            fit = lengths[: np.searchsorted(lengths, room, "right")][::-1]
            worth = self.value[room - fit] + price[fit]
            self.value[room] = self.value[room - 1]
            if len(fit) and worth[k := int(np.argmax(worth))] > self.value[room]:
                self.value[room], self.last[room] = worth[k], fit[k]

    def filled(self, length: int) -> dict[int, int]:
        """The configuration of one piece of this length and the dearest rest."""
        out, room = {length: 1}, len(self.value) - 1 - length
        while room > 0:
            if last := int(self.last[room]):
                out[last] = out.get(last, 0) + 1
            room -= max(last, 1)
        return out


def configurations(counts: np.ndarray, rounds: int = ROUNDS, block: int = BLOCK, rate: float = RATE, levels: float = LEVELS) -> tuple[dict[tuple, float], float]:
    """A fractional cover of counts (by length) by configurations, levels fold if rounds suffice, and a lower bound of a single
    cover's size.

    Every round prices the lengths and takes configurations of the lengths that are covered least.
    """
    capacity = len(counts) - 1
    size, lengths = np.arange(capacity + 1) / capacity, np.flatnonzero(counts)
    covered, x, bound = np.zeros(capacity + 1), {}, 0.0
    for _ in range(rounds):
        least = covered[lengths].min() if len(lengths) else levels
        if least >= levels:
            break
        price = np.where(counts > 0, size * np.exp(-rate * (covered - least)), 0.0)
        dear = Prices(price, lengths)
        bound = max(bound, float((counts * price).sum() / dear.value[capacity]))
        for length in sorted(lengths[np.argsort(covered[lengths], kind="stable")[:block]].tolist(), reverse=True):
            if covered[length] >= least + 1:
                continue
            found = {k: min(n, int(counts[k])) for k, n in dear.filled(length).items()}
            kinds, many = np.array(list(found)), np.array(list(found.values()))
            step = float((counts[kinds] / many).min())
            key = tuple(sorted(found.items()))
            x[key] = x.get(key, 0.0) + step
            covered[kinds] += many * step / counts[kinds]
    return x, bound


def fullest(left: np.ndarray, room: int) -> dict[int, int]:
    """What of left fills room best, in the largest lengths that allow it: a subset sum over bits, backwards from its top."""
    lengths = np.flatnonzero(left[: room + 1]).tolist()
    mask, reach = (1 << (room + 1)) - 1, [1]
    for length in lengths:
        sums, most, step = reach[-1], min(int(left[length]), room // length), 1
        while most > 0:
            take = min(step, most)
            sums |= (sums << (length * take)) & mask
            most, step = most - take, 2 * step
        reach.append(sums)
    goal, out = reach[-1].bit_length() - 1, {}
    for length, below in zip(reversed(lengths), reversed(reach[:-1]), strict=True):
        used = 0
        while goal >= length and used < left[length] and (below >> (goal - length) & 1 or not below >> goal & 1):
            goal, used = goal - length, used + 1
        if used:
            out[length] = used
    return out


def plan(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Configurations with their number of sequences, which hold every counted piece exactly once; and the bound."""
    left, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    found, bound = configurations(left, rounds)
    out, covered = [], np.zeros(capacity + 1)
    for key, times in found.items():
        for k, n in key:
            covered[k] += n * times / counts[k]
    for key, times in found.items():
        if sum(k * n for k, n in key) == capacity:  # what doesn't fill a sequence is better packed with what is left
            whole = min(math.floor(times / max(covered[k] for k, _ in key) + 1e-9), *(int(left[k]) // n for k, n in key))
            if whole > 0:
                out.append((dict(key), whole))
                for k, n in key:
                    left[k] -= n * whole
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        here = fullest(left, capacity - top)
        left[top] += 1
        here[top] = here.get(top, 0) + 1
        times = min(int(left[k]) // n for k, n in here.items())
        for k, n in here.items():
            left[k] -= n * times
        out.append((here, times))
    return out, bound


def ranges(planned: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """One row a (length, first rank), sorted: length, first rank, pieces a sequence, first sequence, offset of the first."""
    rows, used, sequence = [], {}, 0
    for found, times in planned:
        offset = 0
        for length, many in sorted(found.items(), reverse=True):
            rows.append((length, used.get(length, 0), many, sequence, offset))
            used[length] = used.get(length, 0) + many * times
            offset += length * many
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


@tidy
def pack(docs: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    cut = materialize(pieces(docs, capacity))
    by_task = materialize(cut.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    table = ranges(plan(counts, rounds)[0])
    sent = cut.sparkSession.sparkContext.broadcast(table)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches):
        import pyarrow as pa

        rows = sent.value
        firsts = np.searchsorted(rows[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(rank), np.int64)
            for one in np.unique(length):
                here = length == one
                at[here] = firsts[one] + np.searchsorted(rows[firsts[one] : firsts[one + 1], 1], rank[here], "right") - 1
            _, first, many, sequence, offset = rows[at].T
            copy, inside = np.divmod(rank - first, many)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence + copy), pa.array(offset + inside * length)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, StructType([*ranked.schema.fields[:-1], StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
