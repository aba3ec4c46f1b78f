"""Diffeomorphic warp of class priors onto class probabilities, on bricks.

A stationary velocity v is fitted to each volume so that the priors f, pulled through its flow, explain the probabilities g:
the energy is the multinomial one, - sum of g log f over the classes and the rest, plus half of v' R v (see multigrid). The flow
is that of scaling and squaring, d <- d + d(x + d), k times from v / 2^k. Derivatives go back through the very same steps: each
squaring adds J' l and the push of l, the transpose of resampling, whose boxes overlap and are summed by one more exchange.
A Gauss-Newton step solves (A + R) u = b by multigrid; a volume whose energy would rise halves its step, and stays where it is
when a small one rises too, so no volume's energy ever rises on a level.

Halos are as wide as the largest displacement, which is looked up before each step; a task holds one padded brick. Volumes are
independent; all of them take every step together. Values at the border go on beyond it. Volumes of at most two bricks an axis
take all steps of a fit in one task, by the same functions on a block that is the whole volume: one shuffle, not some a step.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import multigrid
from gridloom.operators.bricks import SIDE, Block, bricks, exchange, held_whole, voxels
from gridloom.operators.multigrid import SIX, Regulariser, regularised
from gridloom.operators.tables import cut, release, tidy

#: Fixed values of the schedule: weights of strain and divergence, squarings, of each level; steps a level,
#: V-cycles a step, shares of u in R and in the step, squarings of the last flow.
SCHEDULE = ((4.0, 2.0, 0), (2.0, 1.0, 0), (1.0, 0.5, 1), (0.5, 0.25, 2))
STEPS, CYCLES, OWN, DAMP, LAST = 3, 3, 1e-6, 0.01, 6
#: Added to every class's probability, so that none is zero.
LEAST = 1e-3


class Taps:
    """The eight voxels around displaced places of a block, and their weights; places are held inside the volume."""

    def __init__(self, block: Block, d: np.ndarray, at: tuple[slice, ...]) -> None:
        self.shape, self.base, self.far, self.share, self.inside = block.shape, [], [], [], []
        grids = np.ogrid[tuple(slice(s.start, s.stop) for s in at)]
        for axis in range(3):  # z, y, x; component 2 - axis of d
            n, lo = block.n[axis], block.lo[axis]
            place = grids[axis] + lo + d[2 - axis]
            held = np.clip(place, 0, n - 1)
            base = np.clip(np.floor(held), 0, max(n - 2, 0)).astype(np.int64)
            self.base.append(base - lo)
            self.far.append(np.minimum(base + 1, n - 1) - lo)
            self.share.append(held - base)
            self.inside.append((place == held) & (n > 1))

    def corners(self):
        """(flat index, weights on z, y, x, whether each axis is at its far end)."""
        for ends in np.ndindex(2, 2, 2):
            index = [self.far[a] if e else self.base[a] for a, e in enumerate(ends)]
            yield np.ravel_multi_index(index, self.shape), [self.share[a] if e else 1 - self.share[a] for a, e in enumerate(ends)], ends

    def pull(self, f: np.ndarray, slopes: bool = False):
        """f at the places, and with slopes its derivatives along x, y, z (3, components, ...)."""
        flat = f.reshape(len(f), -1)
        out, slope = 0.0, [0.0, 0.0, 0.0]
        for index, w, ends in self.corners():
            here = flat[:, index]
            out = out + here * (w[0] * w[1] * w[2])
            if slopes:
                for a in range(3):
                    others = [w[k] for k in range(3) if k != a]
                    slope[2 - a] = slope[2 - a] + here * ((1 if ends[a] else -1) * self.inside[a] * others[0] * others[1])
        return (out, np.stack(slope)) if slopes else out

    def push(self, values: np.ndarray) -> np.ndarray:
        """The transpose of pull: each place's values added to its eight voxels."""
        out = np.zeros((len(values), int(np.prod(self.shape))))
        for index, w, _ in self.corners():
            for k, v in enumerate(values * (w[0] * w[1] * w[2])):
                out[k] += np.bincount(index.ravel(), v.ravel(), out.shape[1])
        return out.reshape(len(values), *self.shape)


def _at(array: np.ndarray, core: tuple[slice, ...]) -> np.ndarray:
    return array[(slice(None), *core)]


def reach(pieces: DataFrame, name: str) -> int:
    """The halo that displaced places need."""
    top = pieces.agg(F.max(F.array_max(F.transform(name, lambda x: F.abs(x))))).first()[0]
    return math.ceil(top or 0) + 1


def _keep(pieces: DataFrame, **named) -> DataFrame:
    """Box columns and these fields, each from another column or expression."""
    return pieces.select("t", "kind", "odd", "nz", "ny", "nx", "z0", "y0", "x0", "dz", "dy", "dx", *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()])


def _scaled(column: str, by: float) -> Column:
    return F.transform(column, lambda x: x * by)


def _squared(block: Block) -> Block:
    d = block.fields["d"]
    own = _at(d, block.core)
    return block.cut(["d"]).replaced("d", own + Taps(block, own, block.core).pull(d))


def squared(pieces: DataFrame, side: int = SIDE) -> DataFrame:
    """pieces (d) of d + d(x + d)."""
    return exchange(pieces, {"d": 3}, ["d"], lambda b: [_squared(b)], reach(pieces, "d"), side)


def flow(velocity: DataFrame, squarings: int, side: int = SIDE) -> list[DataFrame]:
    """Displacements (d) of v / 2^squarings and of all its squarings, the last being the flow at time 1."""
    steps = [cut(_keep(velocity, d=_scaled("v", 1 / 2**squarings)))]
    for _ in range(squarings):
        steps.append(cut(squared(steps[-1], side)))
    return steps


def _matched(block: Block, classes: int, slopes: bool) -> Block:
    taps = Taps(block, _at(block.fields["d"], block.core), block.core)
    g = _at(block.fields["g"], block.core)
    f, slope = taps.pull(block.fields["f"], True)
    total = 1 + (classes + 1) * LEAST
    g, p = (np.maximum(np.concatenate([x, 1 - x.sum(0, keepdims=True)]) + LEAST, LEAST / 2) / total for x in (g, f))
    made = block.cut(["d"])
    made.fields = {"e": np.full((1, *made.shape), 0.0)}
    made.fields["e"][0] = -(g * np.log(p)).sum(0)
    if slopes:
        slope = np.concatenate([slope, -slope.sum(1, keepdims=True)], 1) / total
        made.fields["l"] = -(slope * (g / p)).sum(1)
        made.fields["h"] = np.stack([(slope[i] * slope[j] / p).sum(0) for i, j in SIX])
    return made


def matched(images: DataFrame, d: DataFrame, classes: int, side: int = SIDE, slopes: bool = True) -> DataFrame:
    """The energy of f pulled through d against g: e (one value a brick), and with slopes l (derivatives) and h (A)."""
    both = _keep(images, f="f", g="g", d=F.lit(None).cast("array<double>")).unionByName(_keep(d, f=F.lit(None).cast("array<double>"), g=F.lit(None).cast("array<double>"), d="d"))
    return exchange(both, {"f": classes, "g": classes, "d": 3}, ["e", "l", "h"], lambda b: [_matched(b, classes, slopes)], reach(d, "d"), side)


def _unsquared(block: Block) -> dict[str, np.ndarray]:
    own = _at(block.fields["d"], block.core)
    taps = Taps(block, own, block.core)
    l, h = (_at(block.fields[k], block.core) for k in "lh")
    _, slope = taps.pull(block.fields["d"], True)
    out = {"l": taps.push(l), "h": taps.push(h)}
    _at(out["l"], block.core)[:] += l + np.stack([(slope[i] * l).sum(0) for i in range(3)])
    _at(out["h"], block.core)[:] += h
    return out


def unsquared(found: DataFrame, d: DataFrame, side: int = SIDE) -> DataFrame:
    """l and h, derivatives by squared(d), as derivatives by d."""
    halo = reach(d, "d")
    none = F.lit(None).cast("array<double>")
    both = _keep(found, l="l", h="h", d=none).unionByName(_keep(d, l=none, h=none, d="d"))
    pushed = exchange(both, {"l": 3, "h": 6, "d": 3}, ["l", "h"], lambda b: [b.cut(_unsquared(b), grow=halo)], halo, side)
    return exchange(pushed, {"l": 3, "h": 6}, ["l", "h"], lambda b: [b.cut(["l", "h"])], 0, side, add=True)


def _stiffness(v: np.ndarray, reg: Regulariser) -> dict[str, np.ndarray]:
    w = regularised(v, reg)
    return {"v": v, "w": w, "e": 0.5 * (w * v).sum(0, keepdims=True)}


def stiffness(velocity: DataFrame, reg: Regulariser, side: int = SIDE) -> DataFrame:
    """v with w = R v and e = v' R v / 2, voxel by voxel."""
    return exchange(velocity, {"v": 3}, ["v", "w", "e"], lambda b: [b.cut(_stiffness(b.fields["v"], reg))], reg.reach, side)


def _sums(pieces: DataFrame, to: str) -> DataFrame:
    return pieces.groupBy("t").agg(F.sum(F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).alias(to))


def _energy(found: DataFrame, own: DataFrame) -> DataFrame:
    return _sums(found, "data").join(_sums(own, "own"), "t").select("t", (F.col("data") + F.col("own")).alias("energy"))


def energies(images: DataFrame, velocity: DataFrame, squarings: int, classes: int, reg: Regulariser, side: int = SIDE) -> DataFrame:
    """t and energy."""
    steps = flow(velocity, squarings, side)
    out = cut(_energy(matched(images, steps[-1], classes, side, False), stiffness(velocity, reg, side)))
    release(*steps)
    return out


def derivatives(images: DataFrame, velocity: DataFrame, squarings: int, classes: int, reg: Regulariser, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """pieces (a, b): the Gauss-Newton matrix of the data and the derivative of the whole energy by v; and the energies (t, energy)."""
    steps = flow(velocity, squarings, side)
    found = cut(matched(images, steps[-1], classes, side))
    own = cut(stiffness(velocity, reg, side))
    energy = cut(_energy(found, own))
    for d in reversed(steps[:-1]):
        before, found = found, cut(unsquared(found, d, side))
        release(before)
    share = 1 / 2**squarings
    none = F.lit(None).cast("array<double>")
    both = _keep(found, l="l", h="h", w=none).unionByName(_keep(own, l=none, h=none, w="w"))
    out = cut(exchange(both, {"l": 3, "h": 6, "w": 3}, ["a", "b"], lambda b: [b.cut({"a": b.fields["h"] * share, "b": b.fields["l"] * share + b.fields["w"]})], 0, side))
    release(found, own, *steps)
    return out, energy


@tidy
def gauss_newton(images: DataFrame, velocity: DataFrame, squarings: int, classes: int, reg: Regulariser, side: int = SIDE, tries: int = 5) -> DataFrame:
    """velocity (v) after one step; images (f, g)."""
    system, before = derivatives(images, velocity, squarings, classes, reg, side)
    damped = Regulariser(reg.kind, reg.weight, reg.spread, reg.own + DAMP, reg.voxel)
    change = multigrid.solve(system, damped, CYCLES, 2, side).select("t", "z0", "y0", "x0", "u")
    moves = cut(_keep(velocity, v="v").join(change, ["t", "z0", "y0", "x0"]))
    steps = before.select("t", F.lit(1.0).alias("step"), F.col("energy").alias("_before"))
    out = None
    for k in range(tries + 1):
        step = F.col("step") if k < tries else F.lit(0.0)
        tried = cut(_keep(moves.join(steps, "t").withColumn("v", F.zip_with("v", "u", lambda v, u: v - step * u)), v="v"))
        if k == tries:
            good, left = tried, None
        else:
            judged = cut(steps.join(energies(images.join(steps.select("t"), "t", "left_semi"), tried, squarings, classes, reg, side), "t"))
            accepted = judged.where("energy <= _before").select("t")
            good, left = tried.join(accepted, "t", "left_semi"), judged.where("not (energy <= _before)")
        out = good if out is None else out.unionByName(good)
        if left is None or left.isEmpty():
            break
        steps = left.select("t", (F.col("step") / 2).alias("step"), "_before")
    return cut(out)


@tidy
def fit(images: DataFrame, classes: int, schedule=SCHEDULE, steps: int = STEPS, side: int = SIDE) -> DataFrame:
    """The velocity (pieces with v) of images (f, g), level by level."""
    velocity = cut(exchange(images, {"f": classes}, ["v"], lambda b: [b.cut({"v": np.zeros((3, *b.shape))})], 0, side))
    for weight, spread, squarings in schedule:
        for _ in range(steps):
            before = velocity
            velocity = gauss_newton(images, velocity, squarings, classes, Regulariser("elastic", weight, spread, OWN), side)
            release(before)
    return velocity


class Whole:
    """fit() and warped() of one volume in a task: f and g (classes, z, y, x); most is the longest axis of any volume."""

    def __init__(self, f: np.ndarray, g: np.ndarray, most: int, side: int) -> None:
        self.f, self.g, self.most, self.side = f, g, most, side

    def block(self, **fields: np.ndarray) -> Block:
        n = self.f.shape[1:]
        return Block(0, n, (0, 0, 0), fields, core=tuple(slice(0, m) for m in n))

    def flow(self, v: np.ndarray, squarings: int) -> list[np.ndarray]:
        steps = [v * (1 / 2**squarings)]
        for _ in range(squarings):
            steps.append(_squared(self.block(d=steps[-1])).fields["d"])
        return steps

    def matched(self, d: np.ndarray, slopes: bool) -> dict[str, np.ndarray]:
        return _matched(self.block(f=self.f, g=self.g, d=d), len(self.f), slopes).fields

    def energy(self, v: np.ndarray, squarings: int, reg: Regulariser) -> float:
        return self.matched(self.flow(v, squarings)[-1], False)["e"].sum() + _stiffness(v, reg)["e"].sum()

    def gauss_newton(self, v: np.ndarray, squarings: int, reg: Regulariser, tries: int = 5) -> np.ndarray:
        steps, own = self.flow(v, squarings), _stiffness(v, reg)
        found = self.matched(steps[-1], True)
        before = found["e"].sum() + own["e"].sum()
        for d in reversed(steps[:-1]):
            found = _unsquared(self.block(l=found["l"], h=found["h"], d=d))
        share = 1 / 2**squarings
        damped = Regulariser(reg.kind, reg.weight, reg.spread, reg.own + DAMP, reg.voxel)
        u = multigrid.cycled(found["h"] * share, found["l"] * share + own["w"], np.zeros_like(v), damped, self.most, 2, self.side, CYCLES)
        for k in range(tries):
            tried = v - u / 2**k
            if self.energy(tried, squarings, reg) <= before:
                return tried
        return v

    def warped(self, schedule, steps: int, squarings: int = LAST) -> tuple[np.ndarray, np.ndarray]:
        """f pulled through the flow, and its displacement."""
        v = np.zeros((3, *self.f.shape[1:]))
        for weight, spread, halvings in schedule:
            for _ in range(steps):
                v = self.gauss_newton(v, halvings, Regulariser("elastic", weight, spread, OWN))
        d = self.flow(v, squarings)[-1]
        block = self.block(d=d)
        return Taps(block, d, block.core).pull(self.f), d


@tidy
def warped(images: DataFrame, velocity: DataFrame, classes: int, squarings: int = LAST, side: int = SIDE) -> DataFrame:
    """pieces (f, d): f pulled through the flow, and its displacement."""
    d = flow(velocity, squarings, side)[-1]

    def run(block: Block):
        own = _at(block.fields["d"], block.core)
        yield block.cut(["d"]).replaced("f", Taps(block, own, block.core).pull(block.fields["f"]))

    none = F.lit(None).cast("array<double>")
    both = _keep(images, f="f", d=none).unionByName(_keep(d, f=none, d="d"))
    return exchange(both, {"f": classes, "d": 3}, ["f", "d"], run, reach(d, "d"), side)


@tidy
def warp_priors(table: DataFrame, priors: list[str], observed: list[str], shape: tuple[int, int, int], schedule=SCHEDULE, steps: int = STEPS, side: int = SIDE, whole: int | None = None) -> DataFrame:
    """Voxels (t, i, x, y, z) with the warped priors and the displacement dx, dy, dz.

    table (t, x, y, z, priors, observed): both are scaled to at most one half in each volume for the fit. A class is null
    or absent where it is 0; a volume whose priors are all 0 is not moved. whole: the longest axis of volumes that a task takes
    whole (0: none); the result is the same.
    """
    classes = len(priors)
    top = lambda names: F.max(F.greatest(*[F.abs(c) for c in names], F.lit(0.0)))
    tops = table.groupBy("t").agg(top(priors).alias("_f"), top(observed).alias("_g"))
    half = lambda c, by: F.coalesce(F.try_divide(F.col(c), 2 * F.col(by)), F.lit(0.0))
    scaled = table.join(tops, "t").select("t", "x", "y", "z", "_f", *[half(c, "_f").alias(f"f{k}") for k, c in enumerate(priors)], *[half(c, "_g").alias(f"g{k}") for k, c in enumerate(observed)])
    fields, most = {"f": [f"f{k}" for k in range(classes)], "g": [f"g{k}" for k in range(classes)]}, max(shape)
    if held_whole(most, side, whole):

        def run(block: Block):
            f, d = Whole(block.fields["f"], block.fields["g"], most, side).warped(schedule, steps)
            yield block.cut({"f": f, "d": d})

        moved = exchange(bricks(scaled, fields, shape, side), {"f": classes, "g": classes}, ["f", "d"], run, 0, most)
    else:
        images = cut(bricks(scaled, fields, shape, side))
        moved = warped(images, fit(images, classes, schedule, steps, side), classes, side=side)
    out = voxels(moved, {"f": priors, "d": ["dx", "dy", "dz"]})
    return out.join(tops, "t").select("t", "i", "x", "y", "z", *[(F.col(c) * 2 * F.col("_f")).alias(c) for c in priors], "dx", "dy", "dz")
