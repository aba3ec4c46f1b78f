"""Queries process every volume, whatever its id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import components
from gridloom.plans import registry

IDS = (0, 1, 75, 5000)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    rows = [(t, [float(x) for x in rng.normal(size=64) * 0.3], t % 3) for t in IDS]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.mark.parametrize("name", "vox_mixed_gaussian non_local_means watershed patch_fill fast_marching relaxed_prior bias_field label_smooth local_ssd mean_field icm_labels local_map_labels block_match exponentiate spline_field components_26 components_18 largest_component fill_holes distance close_by_distance open_by_distance geodesic".split())
def test_every_volume_has_rows(spark, tables, name):
    assert {r.t for r in registry.QUERIES[name](spark, tables).select("t").distinct().collect()} == set(IDS)


def test_ranks_hold_every_image(spark, tables):
    assert {r.t for r in registry.QUERIES["local_ncc_rank"](spark, tables).select("t").distinct().collect()} == set(IDS) - {0}


def test_every_rater_and_atlas_image_counts(spark, tables):
    run = lambda name: registry.QUERIES[name](spark, tables)
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(tables + "/embeddings.parquet").collect()}
    x = np.arange(64) % 4, np.arange(64) // 4 % 4, np.arange(64) // 16
    assert {r.t for r in run("patch_matches").select("t").distinct().collect()} == set(IDS) - {0}
    assert {r.t for r in run("vox_rician_factor").select("t").distinct().collect()} == set(IDS)
    want = {}
    for t, a in v.items():
        total = np.zeros((4, 4, 4))
        for u in (a.reshape(4, 4, 4), (a * a).reshape(4, 4, 4)):
            for axis in range(3):
                total[tuple(slice(1, -1) if k == axis else slice(None) for k in range(3))] += np.diff(u, 2, axis) ** 2
        want[t] = total.mean()
    assert {r.t: r.bending_energy for r in run("bending_energy").collect()} == pytest.approx(want, abs=1e-5)
    label = {t: (a > 0).astype(int) for t, a in v.items()}
    at = np.column_stack(x)
    sums = np.zeros((64, 2))
    for t in IDS:
        gap = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
        near = [(np.where(label[t][None] == k, gap, np.inf)).min(1) for k in (0, 1)]
        d = np.where(label[t] > 0, near[0], -near[1])
        sums += np.column_stack([-d * np.abs(d), d * np.abs(d)])
    got = {r.i: r.label for r in run("shape_average").collect()}
    clear = [i for i in range(64) if abs(sums[i, 1]) > 0.5]
    assert clear and all(got[i] == int(sums[i, 1] > 0) for i in clear)
    votes = {i: {min(2, max(0, int(np.floor(v[t][i] * 8 + 1.5)))) for t in IDS} for i in range(64)}
    told = {}
    for r in run("staple").collect():
        told.setdefault(r.i, set()).add(r.label)
    assert told == votes


def test_unsettled_relaxation_is_an_error(spark):
    row = spark.createDataFrame([(0, i, i, 0, 0, float(i == 0), 1.0) for i in range(5)], "t int, i int, x int, y int, z int, v double, speed double")
    for run in (lambda: components.distance(row, 2), lambda: components.geodesic(row, 2)):
        with pytest.raises(RuntimeError):
            run()


def test_components_of_long_paths(spark):
    """Two interlocked spirals of one volume, in another volume a single line: no length is too much."""
    import itertools

    at, step, cells = np.array([0, 0]), np.array([1, 0]), set()
    length, n = 20, 20
    while length > 0:
        for _ in range(2 if length < n else 3):
            for _ in range(length):
                cells.add(tuple(int(c) for c in at))
                at = at + step
            step = np.array([-step[1], step[0]])
        length -= 2
    rows = [(7, x + 40 * y, x, y, 0, 1.0) for x, y in cells] + [(1 << 40, x, x, 0, 0, 1.0) for x in range(30)] + [(1 << 40, x + 40 * 2, x, 2, 0, 1.0) for x in range(5)]
    voxels = spark.createDataFrame(rows, "t long, i int, x int, y int, z int, v double")
    want = {}
    for t in (7, 1 << 40):
        places = {(r[2], r[3]): r[1] for r in rows if r[0] == t}
        while places:
            start = min(places, key=places.get)
            seen, todo = {start}, [start]
            for x, y in itertools.chain(todo):
                for d in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                    if (p := (x + d[0], y + d[1])) in places and p not in seen:
                        seen.add(p)
                        todo.append(p)
            for p in seen:
                want[t, places.pop(p)] = start[0] + 40 * start[1]
    assert {(r.t, r.i): r.component for r in components.components(voxels, 6).collect()} == want


def test_rician_factor_at_all_ratios(spark):
    from gridloom.functions import voxelwise as vx

    angle = (np.arange(20000) + 0.5) / 20000 * np.pi
    scaled = lambda q, n: (np.exp(q * (np.cos(angle) - 1)) * np.cos(n * angle)).mean()
    for snr in (0.0, 0.3, 1.0, 3.0, 8.9, 9.0, 15.0, 20.0, 40.0, 200.0):
        q = snr * snr / 4
        want = 2 + snr**2 - np.pi / 8 * ((2 + snr**2) * scaled(q, 0) + snr**2 * scaled(q, 1)) ** 2
        got = spark.range(1).select(vx.rician_factor(F.lit(snr))).first()[0]
        assert got == pytest.approx(want, abs=1e-4) and 0.4 < got < 1.001


def test_label_smoothing_reaches_three_sigma(spark):
    from gridloom.operators import stencil

    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, (5, 6, 7))
    rows = [(0, int(x + 7 * (y + 6 * z)), int(x), int(y), int(z), float(v[z, y, x])) for z in range(5) for y in range(6) for x in range(7)]
    got = {r.i: r.v for r in stencil.label_smooth(spark.createDataFrame(rows, "t int, i int, x int, y int, z int, v double"), 1.0).collect()}
    g = np.stack(np.meshgrid(np.arange(5), np.arange(6), np.arange(7), indexing="ij"), -1).reshape(-1, 3)
    gap = np.abs(g[:, None] - g[None])
    weight = np.exp(-0.5 * (gap**2).sum(2)) * (gap.max(2) <= 3)
    score = np.stack([np.round(weight @ (v.ravel() == k), 9) for k in range(3)], 1)
    assert [got[i] for i in range(len(g))] == score.argmax(1).tolist()


def test_too_many_labels_are_an_error(spark):
    from pyspark.errors import PySparkException

    from gridloom.operators import reshape, stats

    one = spark.createDataFrame([(0, 0, 2e9)], "t int, i int, v double")
    with pytest.raises(ValueError):
        reshape.split_labels(one)
    with pytest.raises(PySparkException):
        stats.label_volumes(one).collect()


def test_quantiles_of_a_single_image_by_range_partitions(spark):
    from gridloom.operators import stats

    rng = np.random.default_rng(5)
    v = rng.normal(size=500).round(1)
    got = sorted((r["rank"], r.v) for r in stats.ranked(spark.createDataFrame([(float(x),) for x in v], "v double").repartition(4)).collect())
    assert got == list(enumerate(sorted(v.tolist())))
