"""Bricks with halos and the multigrid solver, against whole arrays."""

import numpy as np
import pytest

from gridloom.operators import bricks, multigrid


def pieces_of(spark, volumes, side):
    """Pieces of {t: {field: array}} cut into bricks."""
    rows, names = [], list(next(iter(volumes.values())))
    for t, fields in volumes.items():
        n = next(iter(fields.values())).shape[1:]
        for z in range(0, n[0], side):
            for y in range(0, n[1], side):
                for x in range(0, n[2], side):
                    part = {k: v[:, z : z + side, y : y + side, x : x + side] for k, v in fields.items()}
                    rows.append((t, 0, 0, *n, z, y, x, *part[names[0]].shape[1:], *[p.ravel().tolist() for p in part.values()]))
    return spark.createDataFrame(rows, bricks.schema(names))


def arrays_of(df, name):
    """{t: array} of a field of pieces."""
    out = {}
    for r in df.select("t", *bricks.BOX, name).collect():
        shape = (r.dz, r.dy, r.dx)
        part = np.array(r[name]).reshape(-1, *shape)
        whole = out.setdefault(r.t, np.full((len(part), r.nz, r.ny, r.nx), np.nan))
        whole[:, r.z0 : r.z0 + r.dz, r.y0 : r.y0 + r.dy, r.x0 : r.x0 + r.dx] = part
    return out


def problem(shape, seed):
    rng = np.random.default_rng(seed)
    g = rng.normal(size=(3, *shape)) * (rng.random(shape) < 0.5)
    return {"a": np.stack([g[i] * g[j] for i, j in multigrid.SIX]), "b": rng.normal(size=(3, *shape))}


REGULARISERS = [multigrid.Regulariser("membrane", 2.0, 0.0, 0.01, (1.0, 1.5, 2.0)), multigrid.Regulariser("elastic", 2.0, 1.0, 0.01, (1.0, 1.5, 1.0)), multigrid.Regulariser("bending", 1.0, 0.0, 0.05)]


@pytest.mark.parametrize("reg", REGULARISERS, ids=lambda r: r.kind)
def test_the_operator_is_symmetric_and_its_diagonal_right(reg):
    rng = np.random.default_rng(2)
    shape = (4, 3, 5)
    u, w = rng.normal(size=(2, 3, *shape))
    zero = np.zeros((6, *shape))
    assert (multigrid.applied(zero, u, reg) * w).sum() == pytest.approx((multigrid.applied(zero, w, reg) * u).sum())
    assert (multigrid.applied(zero, u, reg) * u).sum() > 0
    diagonal = multigrid._diagonal(shape, reg)
    for at in np.ndindex(3, *shape):
        one = np.zeros((3, *shape))
        one[at] = 1
        assert diagonal[at] == pytest.approx(multigrid.applied(zero, one, reg)[at])


def test_halos_and_sums_of_scattered_boxes(spark):
    rng = np.random.default_rng(0)
    volumes = {t: {"f": rng.normal(size=(2, *shape))} for t, shape in ((1, (9, 17, 5)), (2, (16, 8, 1)), (-3, (3, 2, 20)))}
    table = pieces_of(spark, volumes, 8)

    def box(block):
        f = np.pad(block.fields["f"], ((0, 0), *[(3, 3)] * 3))
        total = sum(f[:, 3 + a : f.shape[1] - 3 + a, 3 + b : f.shape[2] - 3 + b, 3 + c : f.shape[3] - 3 + c] for a in range(-3, 4) for b in range(-3, 4) for c in range(-3, 4))
        yield block.cut({"f": total})

    def grown(block):
        yield block.cut(["f"], grow=2)

    got = arrays_of(bricks.exchange(table, {"f": 2}, ["f"], box, 3, 8), "f")
    for t, v in volumes.items():
        f = np.pad(v["f"], ((0, 0), *[(3, 3)] * 3))
        want = sum(f[:, 3 + a : f.shape[1] - 3 + a, 3 + b : f.shape[2] - 3 + b, 3 + c : f.shape[3] - 3 + c] for a in range(-3, 4) for b in range(-3, 4) for c in range(-3, 4))
        assert np.allclose(got[t], want)
    twice = bricks.exchange(bricks.exchange(table, {"f": 2}, ["f"], grown, 2, 8), {"f": 2}, ["f"], lambda b: [b.cut(["f"])], 0, 8, add=True)
    for t, f in arrays_of(twice, "f").items():
        count = np.ones(f.shape[1:])
        for axis, n in enumerate(f.shape[1:]):
            times = np.array([sum(max(b - 2, 0) <= k < min(b + 10, n) for b in range(0, n, 8)) for k in range(n)])
            count = count * times.reshape([-1 if k == axis else 1 for k in range(3)])
        assert np.allclose(f, volumes[t]["f"] * count)


@pytest.mark.parametrize("reg", REGULARISERS, ids=lambda r: r.kind)
def test_v_cycles_over_bricks_solve_the_system(spark, reg):
    volumes = {5: problem((32, 32, 32), 1), 6: problem((33, 17, 40), 2), 7: problem((9, 30, 11), 3)}
    table = pieces_of(spark, volumes, 16)
    before, gone = None, table
    rates = []
    for _ in range(3):
        gone = multigrid.solve(gone, reg, 1, 2, 16)
        now = {r.t: r.residual / r["size"] for r in multigrid.residuals(gone, reg, 16).collect()}
        rates.append({t: now[t] / (before[t] if before else 1) for t in now})
        before = now
    print(reg.kind, rates)
    assert all(r < 0.45 for rate in rates for r in rate.values())
    u = arrays_of(gone, "u")
    for t, v in volumes.items():
        r = v["b"] - multigrid.applied(v["a"], u[t], reg)
        assert np.linalg.norm(r) / np.linalg.norm(v["b"]) == pytest.approx(before[t], rel=1e-6)


def test_bricks_do_not_change_the_sweeps(spark):
    reg = REGULARISERS[1]
    v = problem((20, 24, 9), 4)
    whole = multigrid.relaxed(v["a"], v["b"], np.zeros((3, 20, 24, 9)), reg, 2)
    run = lambda b: [b.cut({"u": multigrid.relaxed(b.fields["a"], b.fields["b"], b.fields["u"], reg, 2, b.lo)})]
    table = pieces_of(spark, {1: v | {"u": np.zeros((3, 20, 24, 9))}}, 8)
    assert np.allclose(arrays_of(bricks.exchange(table, {"a": 6, "b": 3, "u": 3}, ["u"], run, 4, 8), "u")[1], whole, atol=1e-12)
