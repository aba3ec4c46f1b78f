"""Volumes and grids that a task takes whole: results of bricks and tables, and no exchange for every step."""

import numpy as np

from gridloom.operators import cluster, multigrid, splines, stencil, warp, watershed
from tests.test_multigrid import REGULARISERS, arrays_of, pieces_of, problem
from tests.test_warp import blobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_v_cycles_in_a_task_are_those_of_bricks(spark):
    volumes = {5: problem((17, 12, 9), 2), 6: problem((5, 9, 16), 3)}
    table = pieces_of(spark, {t: v | {"u": v["b"] / 9} for t, v in volumes.items()}, 10)
    found = multigrid.solve(table, REGULARISERS[1], 2, 2, 10)
    assert plan(found).count("FlatMapGroupsInArrow") == 1
    got, want = (arrays_of(x, "u") for x in (found, multigrid.solve(table, REGULARISERS[1], 2, 2, 10, whole=0)))
    assert got.keys() == want.keys() and all(np.allclose(got[t], want[t], atol=1e-10) for t in want)


def test_the_warp_in_a_task_is_that_of_bricks(spark):
    shape = (10, 9, 11)
    f, g = blobs(shape, [(4, 4, 5), (6, 5, 6)]), blobs(shape, [(5, 4, 5), (6, 6, 6)])
    rows = [(t, x, y, z, *map(float, f[:, z, y, x]), *map(float, h[:, z, y, x])) for t, h in ((7, g), (9, f)) for z in range(10) for y in range(9) for x in range(11)]
    table = spark.createDataFrame(rows, "t long, x int, y int, z int, gm double, wm double, pg double, pw double")
    run = lambda **k: warp.warp_priors(table, ["gm", "wm"], ["pg", "pw"], (11, 9, 10), ((0.5, 0.25, 1),), 1, 8, **k)
    found = run()
    assert plan(found).count("FlatMapGroupsInArrow") == 2
    got, want = (d.toPandas().sort_values(["t", "i"]) for d in (found, run(whole=0)))
    assert np.allclose(got, want, atol=1e-9) and np.abs(got.dx).max() > 0.1


def controls(spark, count, scale):
    rng = np.random.default_rng(6)
    rows = [(t, x - 1, y - 1, z - 1, *map(float, scale * (1 + t % 3) * rng.normal(size=3))) for t in range(-2, count) for x in range(4) for y in range(4) for z in range(4) if (t, x, y) != (1, 2, 3)]
    return spark.createDataFrame(rows, "t long, cx int, cy int, cz int, ux double, uy double, uz double")


def same(got, want, keys):
    got, want = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), atol=1e-8, equal_nan=True)


def test_grids_in_a_task_unfold_as_by_tables(spark):
    control = controls(spark, 5, 0.7)
    found = splines.unfolded(control, (5, 4, 5), 5)
    assert plan(found).count("FlatMapGroupsInArrow") == 1 and "Join" not in plan(found)
    same(found, splines.unfolded(control, (5, 4, 5), 5, stacked=False), ["t", "cx", "cy", "cz"])


def test_grids_in_a_task_are_refined_as_by_tables(spark):
    control = controls(spark, 3, 1.0).where("cx > -1 or t <> 2").selectExpr("t", "cx", "cy", "cz", "if(cx = 1, null, ux) as ux", "uy", "if(t = 0, null, uz) as uz")
    found = splines.refined(control)
    assert "Join" not in plan(found)
    same(found, splines.refined(control, stacked=False), ["t", "cx", "cy", "cz"])
    assert found.schema == splines.refined(control, stacked=False).schema


def test_labels_in_a_task_are_those_by_tables(spark):
    rng = np.random.default_rng(8)
    rows = [(t, i, i % 4, i // 4 % 5, i // 20, None if i == 7 else float(rng.normal()), 0 if t == 3 or i % 11 == 0 else int(rng.integers(1, 4))) for t in (-1, 0, 3, 70) for i in range(60)]
    d = spark.createDataFrame(rows, "t long, i int, x int, y int, z int, v double, label int")
    found = cluster.local_map_labels(d, 2, 3)
    assert "Join" not in plan(found)
    same(found, cluster.local_map_labels(d, 2, 3, stacked=False), ["t", "i"])


def smoothed(values, there, weights):
    """Normalised Gaussian means over whole volumes, axis by axis."""
    half = len(weights) // 2
    for axis in (2, 1, 0):
        out = np.full(values.shape, np.nan)
        for p in np.ndindex(*values.shape):
            near = [(w, tuple(c + (k - half) * (a == axis) for a, c in enumerate(p))) for k, w in enumerate(weights)]
            near = [(w, values[q]) for w, q in near if 0 <= q[axis] < values.shape[axis] and not np.isnan(values[q])]
            if there[p] and near:
                out[p] = sum(w * x for w, x in near) / sum(w for w, _ in near)
        values = out
    return values


def test_local_likeness_over_bricks_is_that_of_whole_volumes(spark):
    rng = np.random.default_rng(9)
    shape = (2, 3, 20)
    images = {t: rng.normal(size=shape) for t in (0, 1, 90)}
    images[1][0, 1, 4] = np.nan
    rows = [(t, x + 20 * (y + 3 * z), x, y, z, float(v[z, y, x])) for t, v in images.items() for z in range(2) for y in range(3) for x in range(20)]
    d = spark.createDataFrame(rows, "t long, i int, x int, y int, z int, v double")
    first, weights, there = d.where("t = 0"), stencil.gaussian_weights(1.0), np.ones(shape, bool)
    ncc, ssd = stencil.local_ncc(d, first, 1.0), stencil.local_ssd(d, first, 1.0)
    assert all(plan(f).count("Window [") == 1 and "FlatMapGroupsInArrow" in plan(f) for f in (ncc, ssd))
    got = [{(r.t, r.z, r.y, r.x): r[name] for r in f.collect()} for f, name in ((ncc, "lncc"), (ssd, "v"))]
    b = images[0]
    for t in (0, 90):
        a = images[t]
        ab, aa, bb, ma, mb = (smoothed(x, there, weights) for x in (a * b, a * a, b * b, a, b))
        want = (ab - ma * mb) / (np.sqrt(np.maximum(0, aa - ma * ma) * np.maximum(0, bb - mb * mb)) + np.sqrt(0.01 * (a.var() + b.var())))
        norm = lambda x, m, q: (x - m) / np.sqrt(np.maximum(0, q - m * m) + 0.01 * x.var())
        other = smoothed(norm(a, ma, aa) - norm(b, mb, bb), there, weights) ** 2
        for p in np.ndindex(*shape):
            assert np.isclose(got[0][(t, *p)], want[p]) and np.isclose(got[1][(t, *p)], other[p])
    assert len(got[0]) == len(got[1]) == 3 * 120


def test_a_flood_in_a_task_is_that_of_the_forest(spark):
    rng = np.random.default_rng(10)
    rows = [(t, i % 4, i // 4 % 3, i // 12, i, None if i == 9 else float(rng.integers(4)), 1 + i if i in (5, 30) and t != 1 else None) for t in (0, 1, 2, 70) for i in range(36) if (t, i // 4 % 3) != (2, 1)]
    d = spark.createDataFrame(rows, "t int, x int, y int, z int, i int, v double, marker int")
    found = watershed.watershed(d)
    assert "Join" not in plan(found)
    want = watershed.watershed(d, stacked=False)
    assert found.dtypes == want.dtypes
    same(found, want, ["t", "i"])
