"""Phantoms and invariants of the grid operators, the file format, the step compiler and streaming."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cluster, components, kernels, ranking, registration, reshape, stats, stencil
from gridloom.plans.chain import compile_chain
from gridloom.sources import nifti
from gridloom.sources.voxels import blank, region, with_coordinates
from gridloom.streaming.averages import running_average


def volume(spark, values, nx, ny, t=0):
    return with_coordinates(spark.createDataFrame([(t, i, float(x)) for i, x in enumerate(values)], "t int, i int, v double"), nx, ny)


def single(spark, n=5):
    values = np.zeros((n, n, n))
    values[n // 2, n // 2, n // 2] = 1
    return volume(spark, values.ravel(), n, n)


def test_single_voxel(spark):
    d = single(spark)
    assert stencil.dilate(d, 1).where("v > 0").count() == 27
    assert stencil.count_dilate(d, least=2).where("v > 0").count() == 0 and stencil.count_dilate(d).where("v > 0").count() == 27
    assert stats.centroid(d).first()[1:] == (2.0, 2.0, 2.0)
    assert stats.bounding_box(d).first()[1:] == (2, 0, 2, 0, 2, 0)
    assert stencil.erode(stencil.dilate(d, 1), 1).where("v > 0").count() == 1


def test_ramp(spark):
    d = volume(spark, range(64), 4, 4)
    assert stats.percentile(d, 50).first().percentile == 31 and stats.summary(d).first()["mean"] == 31.5
    assert {r.gx for r in stencil.gradient(d).collect()} == {1.0}
    assert region(d, x=(1, 2), z=(3, 1)).count() == 8


def test_components_and_holes(spark):
    values = np.zeros((7, 7, 7))
    values[0:2, 0:2, 0:2] = 1
    values[5, 5, 5] = 1
    d = volume(spark, values.ravel(), 7, 7)
    assert [(r.n, r["rank"]) for r in components.sized_components(d, 6).orderBy("rank").collect()] == [(8, 1), (1, 2)]
    assert components.largest_component(d).count() == 8
    pair = np.zeros((3, 3, 3))
    pair[0, 0, 0] = pair[1, 1, 1] = 1
    p = volume(spark, pair.ravel(), 3, 3)
    assert components.sized_components(p, 6).count() == 2 and components.sized_components(p, 26).count() == 1
    shell = np.zeros((5, 5, 5))
    shell[1:4, 1:4, 1:4] = 1
    shell[2, 2, 2] = 0
    assert components.fill_holes(volume(spark, shell.ravel(), 5, 5), 5, 5, 5).where("v > 0").count() == 27


def test_reshape_round_trips(spark):
    d = volume(spark, range(64), 4, 4)
    key = lambda x: sorted((r.x, r.y, r.z, r.v) for r in x.select("x", "y", "z", "v").collect())
    assert key(reshape.crop(reshape.pad(d, 2, 4, 4, 4).select("t", "x", "y", "z", "v").withColumn("i", F.lit(0)), 2, 8, 8, 8)) == key(d)
    assert key(reshape.join_interleaved(reshape.split_interleaved(d, "y"), "y")) == key(d)
    assert key(reshape.flip(reshape.flip(d, "z", 4), "z", 4)) == key(d)


def test_ties_and_votes(spark):
    votes = spark.createDataFrame([(0, 0, 2), (0, 1, 1), (0, 2, 0), (1, 0, 1), (1, 1, 1), (1, 2, 2)], "i int, rater long, label int")
    assert {r.i: r.label for r in ranking.majority(votes).collect()} == {0: 0, 1: 1}
    p, theta = ranking.staple(votes, 3, 4)
    assert {round(r.s, 6) for r in p.groupBy("i").agg(F.sum("p").alias("s")).collect()} == {1.0}
    a = votes.where("rater = 0").select("i", "label")
    assert {r.dice for r in stats.dice(a, a).collect()} == {1.0}


def test_mixture_likelihood_never_falls(spark):
    rng = np.random.default_rng(0)
    d = volume(spark, np.r_[rng.normal(0, 1, 300), rng.normal(6, 1, 300)], 10, 10)
    out, params, trail = cluster.mixture(d, 2, 12)
    assert all(b >= a - 1e-6 for a, b in zip(trail, trail[1:], strict=False)) and abs(params[0][1]) < 0.4 and abs(params[1][1] - 6) < 0.4
    labels, means = cluster.kmeans(d.withColumn("v", F.col("v") + 5), 2)
    assert labels.where("label = 1").count() > 250 and len(means) == 2


def test_fits_and_fields(spark):
    rng = np.random.default_rng(2)
    turn = np.array([[0.0, -1, 0, 3], [1, 0, 0, -2], [0, 0, 1, 1], [0, 0, 0, 1]])
    p = rng.normal(size=(60, 3)) * 5
    q = p @ turn[:3, :3].T + turn[:3, 3]
    q[:6] += 30
    names = "px double, py double, pz double, qx double, qy double, qz double"
    pairs = spark.createDataFrame([tuple(map(float, [*a, *b])) for a, b in zip(p, q, strict=True)], names)
    assert np.allclose(registration.affine_fit(pairs, 0.5), turn, atol=1e-6)
    assert np.allclose(registration.rigid_fit(spark.createDataFrame(pairs.collect()[6:], names)), turn, atol=1e-6)
    d = volume(spark, range(64), 4, 4)
    same = registration.resample(registration.affine_field(d, np.eye(4).tolist()), d)
    assert {r.i: r.v for r in same.collect()} == {i: float(i) for i in range(64)}
    assert {round(r.jacobian, 9) for r in registration.jacobian(registration.affine_field(d, (np.diag([2.0, 1, 1, 1])).tolist())).collect()} == {2.0}


def test_kernels():
    a = np.full((4, 4, 4), 3.0)
    assert np.allclose(kernels.non_local_means(1.0)(a), a)
    c = kernels.spline_prefilter(np.arange(64.0).reshape(4, 4, 4) ** 1.1)
    back = c
    for axis in range(3):
        m = np.moveaxis(back, axis, 0)
        e = np.concatenate([m[1:2], m, m[-2:-1]])
        back = np.moveaxis((e[:-2] + 4 * e[1:-1] + e[2:]) / 6, 0, axis)
    assert np.allclose(back, np.arange(64.0).reshape(4, 4, 4) ** 1.1)


def test_nifti_round_trip(spark, tmp_path):
    data = np.arange(2 * 3 * 4 * 5, dtype=float).reshape(2, 3, 4, 5)
    (tmp_path / "a.nii").write_bytes(nifti.build(data, "int16", spacing=(1, 2, 3), descrip="one"))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti.build(data / 7, "int16")))
    heads = {r.img.rsplit("/", 1)[1]: r for r in nifti.headers(spark, str(tmp_path)).collect()}
    assert (heads["a.nii"].nx, heads["a.nii"].nt, heads["a.nii"].dz, heads["a.nii"].descrip) == (5, 2, 3.0, "one")
    got = nifti.voxels(spark, str(tmp_path), times=[1])
    assert got.where("img like '%a.nii'").count() == 60
    row = got.where("img like '%a.nii' and x = 4 and y = 3 and z = 2").first()
    assert row.v == 119.0
    scaled = {r.i: r.v for r in got.where("img like '%.gz'").collect()}
    assert max(abs(scaled[i] - (60 + i) / 7) for i in range(60)) < 1e-3
    files = nifti.encode(got.where("img like '%a.nii'"), 5, 4, 3)
    head, back = nifti.parse("x", bytes(files.first().content))
    assert head["nt"] == 2 and np.array_equal(back[0, 1].ravel(), np.arange(60, 120))
    assert nifti.intlist("3,5..9(2)") == [3, 5, 7, 9]
    with pytest.raises(ValueError):
        nifti.parse("bad", b"x" * 400)


def test_header_tables_and_pairs(spark, tmp_path):
    data = np.arange(2 * 3 * 4 * 5, dtype=float).reshape(2, 3, 4, 5)
    turn = [[0.0, -2.0, 0.0, 7.0], [1.0, 0.0, 0.0, 8.0], [0.0, 0.0, 3.0, 9.0]]
    whole = nifti.build(data, "int16", spacing=(1, 2, 3), sform=turn, descrip="pair")
    head = bytearray(whole[:348])
    head[344:348] = b"ni1\0"
    head[108:112] = np.float32(0).tobytes()
    (tmp_path / "p.hdr").write_bytes(bytes(head))
    (tmp_path / "p.img").write_bytes(whole[352:])
    big = bytearray(np.zeros(348, np.uint8).tobytes())  # another byte order, without a magic word
    big[0:4] = (348).to_bytes(4, "big")
    for k, n in enumerate((3, 5, 4, 3)):
        big[40 + 2 * k : 42 + 2 * k] = n.to_bytes(2, "big")
    big[70:72] = (4).to_bytes(2, "big")
    (tmp_path / "old.hdr").write_bytes(bytes(big))
    (tmp_path / "old.img.gz").write_bytes(gzip.compress(data[1].astype(">i2").tobytes()))
    got = {}
    for r in nifti.voxels(spark, str(tmp_path), "*.hdr").collect():
        got.setdefault(r.img.rsplit("/", 1)[1], {})[r.t, r.i] = r.v
    assert got["p.hdr"] == {(t, i): float(60 * t + i) for t in range(2) for i in range(60)} and got["old.hdr"] == {(0, i): 60.0 + i for i in range(60)}
    heads = nifti.headers(spark, str(tmp_path), "p.hdr")
    table = nifti.voxels(spark, str(tmp_path), "*.hdr").where("img like '%p.hdr'")
    row = nifti.ranged(heads, table).first()
    assert (row.cal_min, row.cal_max) == (0.0, 119.0) and nifti.unscaled(heads).first().scl_slope == 1.0
    back, volume_ = nifti.parse("x", bytes(nifti.encode(table, 5, 4, 3, "int16", heads).first().content))
    assert (back["descrip"], back["dz"], back["sto_xyz"][:3]) == ("pair", 3.0, turn) and np.array_equal(volume_[0], data)
    assert '"descrip":"pair"' in nifti.header_lines(heads).first().json
    assert nifti.with_header_of(table, "other").select("img").distinct().collect() == [("other",)]


def test_chain_fails_before_it_runs(spark):
    d = blank(spark, 3, 3, 3, 2.0)
    assert {r.v for r in compile_chain(["-add", "1", "-mul", "2"])(d).collect()} == {6.0}
    assert {r.v for r in compile_chain(["-sub", "other"], {"other": d})(d).collect()} == {0.0}
    for bad in (["-nope"], ["-thr"]):
        with pytest.raises(ValueError):
            compile_chain(bad)


def test_more_chain_steps(spark):
    rng = np.random.default_rng(6)
    v = np.stack([np.arange(60.0).reshape(3, 4, 5) + rng.normal(size=(3, 4, 5)), rng.normal(size=(3, 4, 5))])
    rows = [(t, x + 5 * (y + 4 * z), x, y, z, float(v[t, z, y, x])) for t in range(2) for z in range(3) for y in range(4) for x in range(5)]
    d = spark.createDataFrame(rows, "t int, i int, x int, y int, z int, v double")
    other = d.where("t = 1").withColumn("v", F.col("v") * 2 + 1)

    def run(*steps, on=d, **images):
        out = compile_chain(list(steps), images)(on).collect()
        return {(r.t, r.z, r.y, r.x): r.v for r in out}

    same = lambda got, want: got.keys() == {k for k, _ in np.ndenumerate(want)} and np.allclose([got[k] for k, _ in np.ndenumerate(want)], want.ravel())
    assert same(run("-z"), (v - v.mean((1, 2, 3), keepdims=True)) / v.std((1, 2, 3), keepdims=True))
    assert same(run("-tmean"), v.mean(0)[None]) and same(run("-tmax"), v.max(0)[None]) and same(run("-tmin"), v.min(0)[None]) and same(run("-tpmax"), v.argmax(0)[None])
    for axis, k in (("x", 3), ("y", 2), ("z", 1)):
        assert same(run(f"-flipimg{axis}"), np.flip(v, k))
    assert same(run("-pad", "1", "-removenan"), np.pad(v, ((0, 0), (1, 1), (1, 1), (1, 1)))) and same(run("-pad", "2", "-crop", "2"), v)
    assert same(run("-merge", "more", more=other), np.concatenate([v, v[1:] * 2 + 1]))
    inner = np.sort(v.reshape(2, -1), 1)[:, [6, 53]]
    keep = [a[(a > lo) & (a < hi)] for a, (lo, hi) in zip(v, inner, strict=True)]
    assert same(run("-zr", "10"), np.stack([(a - k.mean()) / k.std() for a, k in zip(v, keep, strict=True)]))
    labels = d.where("t = 0").withColumn("v", F.floor(F.col("v").cast("double") / 30 + 1).cast("double"))
    split = run("-splitlab", on=labels)
    assert {k[0] for k in split} == {0, 1, 2} and sum(split.values()) == 60
    line = lambda a, b: np.polyfit(a.ravel(), b.ravel(), 1)
    b = v[1] * 2 + 1
    assert same(run("-qlsnorm", "1", "o", o=other), np.stack([np.polyval(line(a, b), a) for a in v]))
    everywhere = other.withColumn("v", F.lit(1.0))
    assert run("-qlsnorm_mask", "1", "o", "m", o=other, m=everywhere) == pytest.approx(run("-qlsnorm", "1", "o", o=other))
    assert run("-qlshnorm_mask", "1", "o", "m", o=other, m=everywhere) == pytest.approx(run("-qlshnorm", "1", "o", o=other))
    exact = run("-lltsnorm", "o", on=d.where("t = 1"), o=other)
    assert np.allclose([exact[1, *k] for k, _ in np.ndenumerate(b)], b.ravel())


def test_chain_steps_of_components_and_distances(spark):
    values = np.zeros((5, 6, 7))
    values[1:4, 1:4, 1:4] = 1
    values[2, 2, 2] = 0
    values[4, 5, 6] = 1
    rows = [(3, x + 7 * (y + 6 * z), x, y, z, float(values[z, y, x])) for z in range(5) for y in range(6) for x in range(7)]
    d = spark.createDataFrame(rows, "t int, i int, x int, y int, z int, v double")
    at = lambda *steps, **images: {(r.z, r.y, r.x): r.v for r in compile_chain(list(steps), images)(d).collect()}
    for step in ("-concomp6", "-concomp26"):
        got = at(step)
        assert got[1, 1, 1] == 1 and got[4, 5, 6] == 2 and got[2, 2, 2] == 0 and sum(v == 1 for v in got.values()) == 26
    assert sum(at("-lconcomp").values()) == 26 and sum(at("-fill").values()) == 28
    euclid, times = at("-euc"), at("-geo", "2")
    assert euclid[2, 2, 2] == -1 and euclid[1, 1, 1] == 1 and euclid[0, 0, 0] == pytest.approx(-(3**0.5))
    assert times[2, 2, 2] == -0.5 and times[1, 1, 1] == 0.5 and times[0, 0, 0] == -1.5
    holed = d.withColumn("v", F.when(F.col("i") == 100, float("nan")).otherwise(F.lit(2.0)))
    filled = compile_chain(["-smoNaN", "m", "1"], {"m": d.withColumn("v", F.lit(1.0))})(holed).collect()
    assert {r.v for r in filled} == {2.0}


def test_running_average_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, float(i * k)) for i in range(4)], "i int, v double").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema("i int, v double").parquet(str(tmp_path / "in*"))
    q = running_average(stream).writeStream.format("memory").queryName("averages").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.i: (r.n, r["mean"]) for r in spark.table("averages").collect()} == {i: (3, float(i)) for i in range(4)}
