"""The warp of priors: derivatives against finite differences, energies that never rise, identity in and out."""

import numpy as np
import pytest

from gridloom.operators import warp
from gridloom.operators.bricks import Block
from gridloom.operators.multigrid import Regulariser
from tests.test_multigrid import arrays_of, pieces_of


def blobs(shape, centres, width=3.0):
    """Two smooth classes around places (z, y, x)."""
    at = np.indices(shape)
    out = [0.45 * np.exp(-sum((g - c) ** 2 for g, c in zip(at, centre, strict=True)) / (2 * width**2)) for centre in centres]
    return np.stack(out)


def test_push_is_the_transpose_of_pull():
    rng = np.random.default_rng(1)
    block = Block(0, (12, 9, 10), (2, 0, 3), {"f": rng.normal(size=(2, 7, 9, 7))})
    core = (slice(1, 6), slice(0, 9), slice(2, 6))
    taps = warp.Taps(block, rng.uniform(-1, 1, (3, 5, 9, 4)), core)
    other = rng.normal(size=(2, 5, 9, 4))
    assert (taps.pull(block.fields["f"]) * other).sum() == pytest.approx((block.fields["f"] * taps.push(other)).sum())


@pytest.mark.parametrize("squarings", [0, 2])
def test_derivatives_match_finite_differences(spark, squarings):
    rng = np.random.default_rng(3)
    shape, reg = (10, 12, 9), Regulariser("elastic", 0.3, 0.2, 0.01)
    f, g = blobs(shape, [(4, 5, 4), (6, 7, 5)]), blobs(shape, [(5, 5, 4), (6, 6, 5)])
    v = 1.2 * np.stack([np.sin(sum(k * a for k, a in zip(rng.uniform(0.2, 0.6, 3), np.indices(shape), strict=True))) for _ in range(3)])
    images = pieces_of(spark, {1: {"f": f, "g": g}}, 8)
    energy = lambda w: warp.energies(images, pieces_of(spark, {1: {"v": w}}, 8), squarings, 2, reg, 8).first()["energy"]
    b = arrays_of(warp.derivatives(images, pieces_of(spark, {1: {"v": v}}, 8), squarings, 2, reg, 8)[0], "b")[1]
    way = rng.normal(size=v.shape)
    h = 1e-5
    assert (energy(v + h * way) - energy(v - h * way)) / (2 * h) == pytest.approx((b * way).sum(), rel=2e-3, abs=1e-4)


def test_energy_never_rises_and_the_priors_move(spark):
    shape = (32, 32, 32)
    near, far = [(14, 16, 15), (20, 12, 18)], [(16, 15, 17), (21, 14, 16)]
    volumes = {1: {"f": blobs(shape, near), "g": blobs(shape, far)}, 2: {"f": blobs(shape, near), "g": blobs(shape, near)}}
    images = pieces_of(spark, volumes, 16)
    velocity = pieces_of(spark, {t: {"v": np.zeros((3, *shape))} for t in volumes}, 16)
    reg = Regulariser("elastic", 0.1, 0.05, 1e-6)
    seen = [{r.t: r.energy for r in warp.energies(images, velocity, 1, 2, reg, 16).collect()}]
    for _ in range(4):
        velocity = warp.gauss_newton(images, velocity, 1, 2, reg, 16)
        seen.append({r.t: r.energy for r in warp.energies(images, velocity, 1, 2, reg, 16).collect()})
    for t in volumes:
        assert all(b[t] <= a[t] + 1e-9 for a, b in zip(seen, seen[1:], strict=False))
    moved = warp.warped(images, velocity, 2, 3, 16)
    got, d = arrays_of(moved, "f"), arrays_of(moved, "d")
    gap = lambda a, b: np.abs(a - b).sum()
    assert gap(got[1], volumes[1]["g"]) < 0.6 * gap(volumes[1]["f"], volumes[1]["g"])
    assert np.abs(d[1]).max() > 0.5 and np.abs(d[2]).max() < 1e-6
    slopes = [[np.gradient(d[1][i], axis=2 - j) + (i == j) for j in range(3)] for i in range(3)]
    assert np.linalg.det(np.moveaxis(np.array(slopes), (0, 1), (-2, -1))).min() > 0


def test_from_voxels_to_voxels(spark):
    shape = (10, 9, 11)
    f, g = blobs(shape, [(4, 4, 5), (6, 5, 6)]), blobs(shape, [(5, 4, 5), (6, 6, 6)])
    rows = [(7, x, y, z, 40 * float(f[0, z, y, x]), 40 * float(f[1, z, y, x]), float(g[0, z, y, x]), float(g[1, z, y, x]), 1) for z in range(10) for y in range(9) for x in range(11)]
    rows += [(8, 0, 0, 0, None, None, 1.0, 0.5, 1)]
    table = spark.createDataFrame(rows, "t long, x int, y int, z int, gm double, wm double, pg double, pw double, v int")
    out = warp.warp_priors(table, ["gm", "wm"], ["pg", "pw"], (11, 9, 10), ((0.5, 0.25, 1),), 2, 8)
    got = out.toPandas()
    assert list(got.columns) == ["t", "i", "x", "y", "z", "gm", "wm", "dx", "dy", "dz"] and len(got) == 2 * 990
    other = got[got.t == 8]
    assert (other.gm == 0).all()
    first = got[got.t == 7].sort_values("i")
    want = np.stack([40 * g[k].ravel() for k in range(2)])
    assert np.abs(np.stack([first.gm, first.wm]) - want).sum() < 0.7 * np.abs(np.stack([40 * f[k].ravel() for k in range(2)]) - want).sum()
    empty = warp.warp_priors(table.limit(0), ["gm", "wm"], ["pg", "pw"], (11, 9, 10), ((0.5, 0.25, 1),), 1, 8)
    assert empty.count() == 0
