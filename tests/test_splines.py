"""Control grids, their Jacobians, gradients and the optimiser, against numpy and finite differences."""

import numpy as np
import pytest

from gridloom.operators import splines

SHAPE, SPACING = (9, 7, 8), 3


def basis(x):
    a = np.abs(x)
    return np.where(a < 1, 2 / 3 - a * a + a**3 / 2, np.where(a < 2, (2 - a) ** 3 / 6, 0))


def slope(x):
    return (basis(x + 1e-6) - basis(x - 1e-6)) / 2e-6


def matrices(f=basis, spacing=SPACING):
    return [f(np.arange(n)[:, None] / spacing - np.arange(-1, splines.last_node(n, spacing) + 1)[None, :]) for n in SHAPE]


def control_of(spark, arrays):
    """{t: (3, cx, cy, cz)} as a table."""
    rows = [(t, i - 1, j - 1, k - 1, *map(float, a[:, i, j, k])) for t, a in arrays.items() for i, j, k in np.ndindex(*a.shape[1:])]
    return spark.createDataFrame(rows, "t long, cx int, cy int, cz int, ux double, uy double, uz double").repartition(3)


def back(df, names, first=0):
    """{t: (names, x, y, z)}."""
    p = df.toPandas()
    axes = ["cx", "cy", "cz"] if first else ["x", "y", "z"]
    return {t: np.stack([g.pivot_table(index=axes, values=n).to_numpy().reshape(*[g[a].nunique() for a in axes]) for n in names]) for t, g in p.groupby("t")}


def random_control(seed, size=1.0):
    return np.random.default_rng(seed).normal(size=(3, *[splines.last_node(n, SPACING) + 2 for n in SHAPE])) * size


def volume_of(spark, arrays):
    rows = [(t, x, y, z, float(v[x, y, z])) for t, v in arrays.items() for x, y, z in np.ndindex(*v.shape)]
    return spark.createDataFrame(rows, "t long, x int, y int, z int, v double")


def smooth(shape, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    at = np.indices(shape).astype(float)
    return 10 + 4 * sum(np.sin(sum(w * (a + shift) for w, a in zip(rng.uniform(0.2, 0.7, 3), at, strict=True)) + rng.uniform(0, 6)) for _ in range(2))


def test_fields_jacobians_and_their_transposes(spark):
    arrays = {1: random_control(1, 0.5), 4: random_control(2, 0.5)}
    control = control_of(spark, arrays)
    b, s = matrices(), matrices(slope)
    field = back(splines.displacements(control, SHAPE, SPACING), ["ux", "uy", "uz"])
    jac = back(splines.jacobians(control, SHAPE, SPACING), [*splines.SLOPES, "det"])
    for t, a in arrays.items():
        assert np.allclose(field[t], np.einsum("xi,yj,zk,cijk->cxyz", *b, a))
        want = np.stack([np.einsum("xi,yj,zk,ijk->xyz", *[s[k] / SPACING if k == axis else b[k] for k in range(3)], a[c]) + (c == axis) for c in range(3) for axis in range(3)])
        assert np.allclose(jac[t][:9], want, atol=1e-6)
        assert np.allclose(jac[t][9], np.linalg.det(np.moveaxis(want.reshape(3, 3, *SHAPE), (0, 1), (-2, -1))), atol=1e-6)
    rng = np.random.default_rng(3)
    w = rng.normal(size=(9, *SHAPE))
    rows = [(1, x, y, z, *map(float, w[:, x, y, z])) for x, y, z in np.ndindex(*SHAPE)]
    table = spark.createDataFrame(rows, "t long, x int, y int, z int, " + ", ".join(f"{j} double" for j in splines.SLOPES))
    got = back(splines.slopes_to_nodes(table, SPACING), ["ux", "uy", "uz"], 1)[1]
    unit = jac[1][:9] - np.eye(3).reshape(9, 1, 1, 1)
    n = got.shape[1:]
    assert (got * arrays[1][:, : n[0], : n[1], : n[2]]).sum() == pytest.approx((w * unit).sum())


def test_refined_grids_give_the_same_field_and_affine_grids_their_matrix(spark):
    spacing = 4
    a = np.random.default_rng(5).normal(size=(3, *[splines.last_node(n, spacing) + 2 for n in SHAPE]))
    control = control_of(spark, {2: a})
    fine = splines.refined(control)
    x, y = (back(splines.displacements(c, SHAPE, h), ["ux", "uy", "uz"])[2] for c, h in ((control, 4), (fine, 2)))
    assert np.abs(x - y).max() < 1e-9
    matrix = [[1.1, 0.2, 0, 3], [0, 0.9, 0.1, -1], [0.3, 0, 1, 0.5]]
    field = back(splines.displacements(splines.grid(control, SHAPE, 3, matrix), SHAPE, 3), ["ux", "uy", "uz"])[2]
    at = np.indices(SHAPE)
    want = np.einsum("ij,jxyz->ixyz", np.array(matrix)[:, :3], at) + np.array(matrix)[:, 3].reshape(3, 1, 1, 1) - at
    assert np.allclose(field, want)


@pytest.mark.parametrize("kind", ["ssd", "nmi", "bending", "penalty"])
def test_gradients_match_finite_differences(spark, kind):
    target, source = (volume_of(spark, {1: smooth(SHAPE, 1, s)}) for s in (0, 0.4))
    a = random_control(7, 0.15)
    way = np.random.default_rng(8).normal(size=a.shape)
    if kind == "bending":
        cost = lambda c: splines.bending(c)[0].first()["cost"]
        gradient = splines.bending(control_of(spark, {1: a}))[1]
    elif kind == "penalty":
        cost = lambda c: splines.jacobian_penalty(c, SHAPE, SPACING).first()["penalty"]
        gradient = splines.penalty_gradient(control_of(spark, {1: a}), SHAPE, SPACING)
    else:
        cost = lambda c: splines.similarity(target, source, c, SHAPE, SPACING, kind).first()["cost"]
        gradient = splines.node_gradient(target, source, control_of(spark, {1: a}), SHAPE, SPACING, kind)
        edge = [slice(1, -2)] * 3  # so that no place crosses the border
        inner = np.zeros_like(way)
        inner[(slice(None), *edge)] = way[(slice(None), *edge)]
        way = inner * 0.2
    g = np.zeros_like(a)
    for r in gradient.collect():
        if max(r.cx + 2 - a.shape[1], r.cy + 2 - a.shape[2], r.cz + 2 - a.shape[3]) <= 0:
            g[:, r.cx + 1, r.cy + 1, r.cz + 1] = (r.ux, r.uy, r.uz)
    h = 1e-5
    near = [cost(control_of(spark, {1: a + k * h * way})) for k in (1, -1)]
    assert (near[0] - near[1]) / (2 * h) == pytest.approx((g * way).sum(), rel=2e-3, abs=1e-7)


def test_folds_are_mended_where_they_are(spark):
    a = np.zeros((3, *[splines.last_node(n, SPACING) + 2 for n in SHAPE]))
    a[0, 2, 2, 2], a[0, 3, 2, 2] = 6.0, -6.0
    arrays = {1: a, 2: random_control(9, 0.05)}
    control = control_of(spark, arrays)
    before = {r.t: r for r in splines.jacobian_penalty(control, SHAPE, SPACING).collect()}
    assert before[1].folded > 0 and before[1].least < 0 and before[2].folded == 0
    mended = splines.unfolded(control, SHAPE, SPACING)
    after = {r.t: r for r in splines.jacobian_penalty(mended, SHAPE, SPACING).collect()}
    assert after[1].folded == 0 and after[1].least > 0
    assert np.array_equal(back(mended, ["ux", "uy", "uz"], 1)[2], arrays[2])


@pytest.mark.parametrize("kind", ["ssd", "nmi"])
def test_costs_fall_and_shifted_images_meet(spark, kind):
    volumes = {1: (0, 1.2), 2: (0, 0)}
    target, source = (volume_of(spark, {t: smooth(SHAPE, 1, s[k]) for t, s in volumes.items()}) for k in (0, 1))
    control = splines.grid(target, SHAPE, SPACING)
    costs = lambda c: {r.t: r.cost for r in splines.similarity(target, source, c, SHAPE, SPACING, kind).collect()}
    first = costs(control)
    after = costs(splines.optimise(target, source, control, SHAPE, SPACING, kind, 0.001 if kind == "ssd" else 1e-4, 2))
    assert after[1] < (0.5 * first[1] if kind == "ssd" else first[1] - 0.05)
    assert after[2] <= first[2] + 1e-9
