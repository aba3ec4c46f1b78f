"""Simple points, and thinning and erosion that keep the topology: 26-connected foreground, 6-connected background.

A foreground voxel is simple if its removal changes neither: of its 26 neighbours the set ones make one 26-connected part, and
the clear ones among the 18 nearest make one 6-connected part that touches it on a face. Whether it is depends on a code of
26 bits, and is worked out for the codes that occur. Voxels whose coordinates have the same parity on each axis are never
neighbours, so all simple ones of a parity can go at once; the eight parities take turns.

A pass over the parities is one exchange of bricks, with a halo as wide as eight removals reach: the result is that of passes
over the whole volume. Beyond the border is background.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.bricks import SIDE, Block, bricks, exchange
from gridloom.operators.tables import cut, release, tidy

#: Places (z, y, x) of the cube around a voxel; bit k of a code is place k's voxel. The middle has no bit set.
PLACES = list(product((-1, 0, 1), repeat=3))
MIDDLE = PLACES.index((0, 0, 0))
PARITIES = list(product((0, 1), repeat=3))


def _adjacency(most: int, among: int) -> np.ndarray:
    """For each place the bits of the places next to it (differing on at most `most` axes, by one), of those at most `among` axes
    away from the middle; the middle is next to none."""
    out = np.zeros(27, np.int64)
    for i, p in enumerate(PLACES):
        for j, q in enumerate(PLACES):
            steps = [abs(a - b) for a, b in zip(p, q, strict=True)]
            if MIDDLE not in (i, j) and i != j and max(steps) == 1 and sum(steps) <= most and all(0 < sum(map(abs, k)) <= among for k in (p, q)):
                out[i] |= 1 << j
    return out


_NEAR26, _NEAR6 = _adjacency(3, 3), _adjacency(1, 2)
_ALL = sum(1 << k for k in range(27) if k != MIDDLE)
_NEAREST18 = sum(1 << k for k, p in enumerate(PLACES) if 0 < sum(map(abs, p)) <= 2)
_FACES = sum(1 << k for k, p in enumerate(PLACES) if sum(map(abs, p)) == 1)


def _grown(seed: np.ndarray, inside: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The bits of inside that are connected with seed."""
    while True:
        more = seed.copy()
        for k in range(27):
            more |= np.where(seed >> k & 1, near[k], 0)
        more &= inside
        if (more == seed).all():
            return seed
        seed = more


def simple(codes: np.ndarray) -> np.ndarray:
    """Whether voxels with these neighbours (27 bits, the middle clear) are simple."""
    found, back = np.unique(codes, return_inverse=True)
    front = found & _ALL
    one = _grown(front & -front, front, _NEAR26) == front
    clear = ~found & _NEAREST18
    faces = clear & _FACES
    part = _grown(faces & -faces, clear, _NEAR6)
    return (one & (front != 0) & (faces != 0) & (part & faces == faces))[back]


def codes(mask: np.ndarray, at: tuple[np.ndarray, ...]) -> np.ndarray:
    """The codes of the voxels at these places of a mask (z, y, x) that is padded by one clear voxel on each side."""
    out = np.zeros(len(at[0]), np.int64)
    for k, p in enumerate(PLACES):
        if k != MIDDLE:
            out |= mask[tuple(a + 1 + d for a, d in zip(at, p, strict=True))].astype(np.int64) << k
    return out


def masks(voxels: DataFrame, shape: tuple[int, int, int], side: int = SIDE) -> DataFrame:
    """Pieces (m) of the voxels (t, x, y, z) that are set."""
    return bricks(voxels.select("t", "x", "y", "z", F.lit(1.0).alias("m")), {"m": ["m"]}, shape, side)


def _pass(pieces: DataFrame, side: int, ends: bool, border: bool) -> DataFrame:
    """Each parity's simple voxels removed in turn; ends: those with one neighbour at most stay; border: only what had a clear face
    when the pass began may go. c is how many of a brick went."""

    def run(block: Block):
        whole = np.pad(block.fields["m"][0] > 0, 1)
        allowed = np.ones(block.shape, bool)
        if border:
            core = whole[1:-1, 1:-1, 1:-1]
            full = core.copy()
            for axis in range(3):
                for d in (0, 2):
                    full &= whole[tuple(slice(d, d + n) if k == axis else slice(1, -1) for k, n in enumerate(core.shape))]
            allowed = ~full
        before = whole.copy()
        for parity in PARITIES:
            own = np.zeros(block.shape, bool)
            own[tuple(slice((p - lo) % 2, None, 2) for p, lo in zip(parity, block.lo, strict=True))] = True
            at = np.nonzero(whole[1:-1, 1:-1, 1:-1] & own & allowed)
            if len(at[0]):
                found = codes(whole, at)
                gone = simple(found)
                if ends:
                    gone &= np.bitwise_count(found) > 1
                whole[tuple(a[gone] + 1 for a in at)] = False
        made = block.cut({"m": whole[1:-1, 1:-1, 1:-1][None].astype(float)})
        made.fields["c"] = np.zeros_like(made.fields["m"])
        made.fields["c"].flat[0] = block.cut({"c": (before != whole)[1:-1, 1:-1, 1:-1][None]}).fields["c"].sum()
        yield made

    return exchange(pieces, {"m": 1}, ["m", "c"], run, len(PARITIES) + 1, side)


@tidy
def thinned(pieces: DataFrame, side: int = SIDE, ends: bool = True) -> DataFrame:
    """What is left of the masks (m) when no simple voxel is; with ends, lines keep theirs, else parts without holes shrink to a
    voxel. Rounds go on while any volume changes."""
    while True:
        before, pieces = pieces, cut(_pass(pieces, side, ends, True))
        went = pieces.agg(F.sum(F.col("c")[0])).first()[0] or 0
        if "c" in before.columns:
            release(before)
        if not went:
            return pieces


@tidy
def eroded(pieces: DataFrame, rounds: int, side: int = SIDE) -> DataFrame:
    """The masks (m) after some rounds of removing simple voxels of their border only: an erosion that tears and loses nothing."""
    for _ in range(rounds):
        pieces = cut(_pass(pieces, side, False, True))
    return pieces


def euler_number(voxels: DataFrame) -> DataFrame:
    """t, euler: vertices - edges + faces - voxels of the closed cubes of the set voxels (t, x, y, z), in doubled coordinates."""
    cells = voxels.select("t", *[(2 * F.col(a)).alias(a) for a in "xyz"])
    for a in "xyz":
        cells = cells.withColumn(a, F.explode(F.sequence(F.col(a) - 1, F.col(a) + 1)))
    odd = sum((F.pmod(F.col(a), F.lit(2)) for a in "xyz"), F.lit(0))
    return cells.distinct().groupBy("t").agg(F.sum(F.when(odd % 2 == 1, 1).otherwise(-1)).cast("bigint").alias("euler"))
