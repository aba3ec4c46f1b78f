"""Optimisers that go on until they are done: by tables and in a task, and what the queries reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import multigrid, splines, stencil, warp
from gridloom.plans import registry
from gridloom.sources.voxels import cubes
from tests.test_splines import SHAPE, SPACING, control_of, random_control, smooth, volume_of

SF = "/root/testdata/sf0.001"


def test_rounds_in_a_task_are_those_by_tables(spark):
    shifts = {1: (0, 0.8), 2: (0, 0), 4: (0, 0.3)}
    target, source = (volume_of(spark, {t: smooth(SHAPE, t, s[k]) for t, s in shifts.items()}) for k in (0, 1))
    # voxels absent and null, nodes absent, a volume without source, one that is not asked for
    target = target.where("not (t = 1 and x = 3 and y < 4)").withColumn("v", F.when(F.expr("t = 1 and z = 2 and x = 5"), None).otherwise(F.col("v")))
    source = source.where("t <> 4 and not (t = 1 and x > 6)").withColumn("v", F.when(F.expr("t = 1 and y = 5"), None).otherwise(F.col("v")))
    control = control_of(spark, {1: random_control(3, 0.1), 2: 0 * random_control(3), 3: random_control(5, 0.1), 4: random_control(4, 0.1)}).where("not (t = 1 and cx = 4 and cy = 1)")
    run = lambda **k: splines.optimise(target, source, control, SHAPE, SPACING, "ssd", 0.01, 2, **k)
    found, want = run(), run(whole=0)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.dtypes == want.dtypes
    keys = ["t", *splines.NODES]
    got, want, first = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (found, want, control))
    assert len(got) == len(want) == len(first)
    assert np.allclose(got, want, atol=1e-9)
    moved = np.abs(got[splines.MOVES] - first[splines.MOVES]).groupby(got.t).max().max(axis=1)
    assert moved[1] > 0.01 and moved[2] == moved[3] == moved[4] == 0


@pytest.mark.parametrize("whole", [None, 0])
def test_the_optimiser_ends_where_no_step_lowers_the_cost(spark, whole):
    at = np.indices((4, 3, 3))[0]
    target, source = (volume_of(spark, {1: v, 2: at + 1.0}) for v in (at + 1.0, at + 1.4))
    control = splines.grid(target, (4, 3, 3), 3)
    run = lambda grid: splines.optimise(target, source, grid, (4, 3, 3), 3, "ssd", 0.5, tries=2, whole=whole)
    once = run(control)
    names = ["t", *splines.NODES, *splines.MOVES]
    first, again = (sorted(map(tuple, d.select(names).collect())) for d in (once, run(once)))
    assert first == again and len(first) == control.count()
    assert all(r[4:] == (0, 0, 0) for r in first if r[0] == 2)


def test_ffd_optimised_brings_the_shifted_volume_back(spark):
    found = registry.QUERIES["ffd_optimised"](spark, SF)
    target = stencil.box_mean(cubes(spark, SF).select("t", "x", "y", "z", "v"), 2)
    source = target.withColumn("x", F.col("x") - 1).where("x >= 0")
    cost = lambda c: splines.similarity(target, source, c, (32, 32, 32), 8).first()["cost"]
    assert cost(found) < 0.02 * cost(splines.grid(target, (32, 32, 32), 8))


def test_warp_priors_takes_three_steps_a_level(spark):
    got = registry.QUERIES["warp_priors"](spark, SF).toPandas().sort_values(["t", "i"])
    smooth_ = stencil.box_mean(cubes(spark, SF).select("t", "x", "y", "z", "v"), 2).toPandas()
    v = np.zeros((32, 32, 32))
    v[smooth_.z, smooth_.y, smooth_.x] = smooth_.v
    near = np.stack([np.maximum(v, 0), np.maximum(-v, 0)])
    far = np.zeros_like(near)
    far[..., :-1] = near[..., 1:]
    halves = [a / (2 * a.max()) for a in (near, far)]
    f, d = warp.Whole(*halves, 32, 16).warped(((4.0, 2.0, 0), (2.0, 1.0, 0), (1.0, 0.5, 1), (0.5, 0.25, 2)), 3)
    want = np.concatenate([f * 2 * near.max(), d]).reshape(5, -1)
    assert np.allclose(got[["gm", "wm", "dx", "dy", "dz"]].to_numpy().T, want, atol=2e-4)


def test_the_elastic_regulariser_is_the_derivative_of_its_energy():
    rng = np.random.default_rng(4)
    h = (1.0, 2.0, 0.5)

    def energy(u):
        slope = np.zeros((3, 3, *u.shape[1:]))  # of a component along an axis
        for j in range(3):
            ahead = np.moveaxis(slope[:, j], 3 - j, 0)
            ahead[:-1] = np.diff(np.moveaxis(u, 3 - j, 0), axis=0) / h[j]
        strain = (slope + slope.swapaxes(0, 1)) / 2
        return 0.7 * (strain**2).sum() + 0.15 * (slope[0, 0] + slope[1, 1] + slope[2, 2]).ravel().dot((slope[0, 0] + slope[1, 1] + slope[2, 2]).ravel()) + 0.005 * (u * u).sum()

    for shape in ((5, 4, 6), (1, 3, 2)):
        u, way = rng.normal(size=(2, 3, *shape))
        got = (multigrid.regularised(u, multigrid.Regulariser("elastic", 0.7, 0.3, 0.01, h)) * way).sum()
        assert got == pytest.approx((energy(u + way) - energy(u - way)) / 2)
