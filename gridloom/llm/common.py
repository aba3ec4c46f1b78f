"""What the text operators share: shared-folder tables, in-row helpers and a vectorised tokenizer."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shared import materialize, release, tidy  # noqa: F401

#: White space of every word definition here: blank and code points 9 to 13.
WORD_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns of these names under other names, and what gives its columns back, named as before."""
    new = {c: c for c in docs.columns}
    for c in [c for c in docs.columns if c.lower() in names]:
        while new[c].lower() in {x.lower() for x in (*docs.columns, *names)}:
            new[c] += "_"
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), lambda out: out.select(*[F.col(f"`{n}`").alias(c) for c, n in new.items()])


def others(columns: list[str], own: tuple[str, ...]) -> list[str]:
    """The columns that an operator's own ones don't replace; like Spark, names that differ in case only are one."""
    return [c for c in columns if c.lower() not in own]


def running_sums(lengths: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Sums (or another running value, from 0) of the elements before each place of an array of bigint, in near linear
    time: blocks of 64, then inside them."""
    size = 64
    zero = F.array().cast("array<bigint>")

    def inside(part: Column, base: Column) -> Column:
        grown = F.aggregate(part, F.struct(base.alias("at"), zero.alias("seen")), lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")))
        return grown

    def blocks(arr: Column) -> Column:
        n = F.size(arr)
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("parts"))
        step = lambda acc, i: let(inside(F.slice(arr, i, size), acc["at"]), lambda g: F.struct(g["at"].alias("at"), F.concat(acc["parts"], F.array(g["seen"])).alias("parts")))
        return F.when(n == 0, zero).otherwise(F.flatten(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size)), start, step)["parts"]))

    return let(lengths, blocks)


def lower_bound(sorted_longs: list[int], value: Column) -> Column:
    """How many of the driver's sorted bounds are <= value, by a binary search inside the row."""
    if not sorted_longs:
        return F.lit(0)
    bounds = F.transform(F.split(F.lit(",".join(map(str, sorted_longs))), ","), lambda x: x.cast("bigint"))
    n, steps = len(sorted_longs), max(1, len(sorted_longs).bit_length())

    def search(b: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            right = (acc["lo"] < acc["hi"]) & (F.element_at(b, F.least(mid + 1, F.lit(n))) <= value)
            return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(F.least(mid, acc["hi"])).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), step, lambda acc: acc["lo"])

    return let(bounds, search)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- words of Arrow string columns as 64-bit hashes, without a Python object for each word

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = np.where(_SPACE, np.uint8(32), _LOWER)
_SEGMENT = 1 << 20
#: Spans of more bytes are hashed one by one.
_LONG = 1 << 12
#: Two primes below 2^31, each with a base of its own.
_MODULI = ((2147483647, 1103515245), (2147483629, 1566083941))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of both hash bases and of their inverses for every place of a segment, made once."""

    def __init__(self) -> None:
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []

    def need(self) -> None:
        if not self.up:
            for p, base in _MODULI:
                for held, x in ((self.up, base), (self.down, pow(base, -1, p))):
                    out = np.ones(1, np.uint64)
                    while len(out) < _SEGMENT + _LONG + 1:
                        out = np.concatenate([out, out * np.uint64(pow(x, len(out), p)) % np.uint64(p)])
                    held.append(out)


_POWERS = Powers()


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the n + 1 offsets of its rows; a null is an empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def small_batches(batches, column: str, most: int = 4 << 20):
    """The batches cut so that the named texts of each hold at most `most` bytes, or one row."""
    for batch in batches:
        _, at = flat_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; a word ends with its text."""
    solid = ~_SPACE[raw]
    if not solid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order of their starts, in segments of bounded memory.

    A span of up to _LONG bytes is hashed as a polynomial modulo two primes (a power of two as modulus would give some
    long words equal hashes under any base), a longer one by BLAKE2b. Equal hashes mean equal spans but for chance.
    """
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    short = np.flatnonzero(size <= _LONG)
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    _POWERS.need()
    starts, ends, size = starts[short], ends[short], size[short].astype(np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + _SEGMENT - 1, "right")))
        top = int(ends[i:j].max())
        s, e = starts[i:j] - base, ends[i:j] - base
        text = raw[base:top].astype(np.uint64) + np.uint64(1)
        both = []
        for (p, _), up, down in zip(_MODULI, _POWERS.up, _POWERS.down, strict=True):
            sums = np.zeros(top - base + 1, np.uint64)  # below 2^8 * 2^31 * 2^21
            np.cumsum(text * up[: top - base], out=sums[1:])
            both.append((sums[e] - sums[s]) % np.uint64(p) * down[s] % np.uint64(p))
        out[short[i:j]] = mix64(both[0] << np.uint64(33) | both[1] << np.uint64(2) | size[i:j] & np.uint64(3))
        i = j
    return out


def joined_words(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every text's words (A-Z lower-cased) with one blank between two, and the n + 1 offsets of the texts."""
    raw, at = flat_bytes(column)
    starts, ends = word_bounds(raw, at)
    words = np.searchsorted(starts, at)
    keep = ~_SPACE[raw]
    followed = np.ones(len(starts), bool)
    followed[words[1:][np.diff(words) > 0] - 1] = False
    keep[ends[followed]] = True
    text = _FOLDED[raw[keep]]
    return text, np.concatenate([[0], np.cumsum(keep)])[at]


def word_hashes(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts text[at[i]:at[i + 1]] and the n + 1 word offsets of these."""
    starts, ends = word_bounds(text, at)
    return span_hashes(text, starts, ends), np.searchsorted(starts, at)


_SHINGLE = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(words: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's width-word shingles; fewer words make one shingle, none an empty set."""
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : len(words) - width + 1 + k] * _SHINGLE[k]
        rolled = mix64(rolled)
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield mix64(np.array([(words[a:b] * _SHINGLE[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
