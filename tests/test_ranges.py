import gzip

import numpy as np
import pytest

from gridloom.sources import nifti, ranges


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("volumes")
    rng = np.random.default_rng(1)
    arrays = {"a.nii": rng.normal(size=(3, 6, 5, 7)).astype("f4"), "deep/b.nii": rng.integers(-90, 90, size=(2, 4, 3, 5)).astype(float), "c.nii.gz": rng.normal(size=(2, 3, 4)).astype("f4")}
    made = {"a.nii": nifti.build(arrays["a.nii"]), "deep/b.nii": nifti.build(arrays["deep/b.nii"], "int16", 2.0, -3.0), "c.nii.gz": gzip.compress(nifti.build(arrays["c.nii.gz"]))}
    ranges.write(spark.createDataFrame(list(made.items()), "img string, content binary"), str(root))
    (root / "notes.txt").write_text("no volume")
    return str(root), made


def rows(df):
    return sorted((r.img, r.u, r.t, r.z, r.y, r.x, r.i, r.v) for r in df.collect())


def whole(made):
    out = []
    for name, content in made.items():
        head, data = nifti.parse(name, content)
        for (u, t, z, y, x), v in np.ndenumerate(data.astype(float)):
            v = v * head["scl_slope"] + head["scl_inter"] if head["scl_slope"] else v
            out.append((name, u, t, z, y, x, x + data.shape[4] * (y + data.shape[3] * z), float(v)))
    return sorted(out)


@pytest.mark.parametrize("split", [1 << 20, 100, 7])
def test_every_voxel_once_wherever_files_are_cut(spark, folder, split):
    path, made = folder
    assert rows(ranges.voxels(spark, path, split_bytes=split)) == whole(made)


def test_filters_choose_the_bytes(spark, folder, monkeypatch):
    path, made = folder
    found = ranges.voxels(spark, path, split_bytes=64).where("t = 1 and z >= 1 and z < 3 and y in (0, 2) and x > 0 and img <> 'c.nii.gz'")
    assert rows(found) == [r for r in whole(made) if r[2] == 1 and r[3] in (1, 2) and r[4] in (0, 2) and r[5] > 0]
    reader, seen = ranges.RangeReader({"path": path, "split_bytes": "100000"}), []
    filters = [ranges.EqualTo(("t",), 1), ranges.EqualTo(("z",), 2), ranges.EqualTo(("img",), "a.nii")]
    assert list(reader.pushFilters(filters)) == filters
    monkeypatch.setattr(ranges, "GAP", 0)
    plain = ranges._File.at
    monkeypatch.setattr(ranges._File, "at", lambda self, place, size: seen.append((place, size)) or plain(self, place, size))
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 35
    assert seen == [(0, 348), (352 + 4 * 35 * (6 + 2), 4 * 35)]


def test_headers_read_headers_only(spark, folder):
    path, made = folder
    found = {r.img: r for r in ranges.headers(spark, path).collect()}
    assert {k: r.asDict() for k, r in found.items()} == {k: nifti.parse(k, c)[0] for k, c in made.items()}
    reader = ranges.RangeReader({"path": path, "view": "headers"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


def test_pairs_short_files_and_empty_folders(spark, tmp_path):
    volume = np.arange(24.0).reshape(2, 3, 4)
    content = bytearray(nifti.build(volume))
    content[344:348] = b"ni1\0"
    content[108:112] = b"\0" * 4
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "q.hdr").write_bytes(content[:348])
    (tmp_path / "p" / "q.img").write_bytes(content[352:])
    assert [r[7] for r in rows(ranges.voxels(spark, str(tmp_path / "p"), "*.img", 10))] == sorted(volume.ravel())
    (tmp_path / "none").mkdir()
    assert ranges.voxels(spark, str(tmp_path / "none")).count() == 0 and ranges.headers(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "s.nii").write_bytes(nifti.build(volume)[:400])
    with pytest.raises(Exception, match="ends before byte"):
        ranges.voxels(spark, str(tmp_path / "short")).count()


def test_files_replace_their_own_names_only(spark, tmp_path):
    table = lambda *rows: spark.createDataFrame(list(rows), "img string, content binary")
    ranges.write(table(("a.nii", b"1"), ("s/b.nii", b"2")), str(tmp_path))
    ranges.write(table(("a.nii", b"3")), f"file:{tmp_path}")
    assert {str(f.relative_to(tmp_path)): f.read_bytes() for f in tmp_path.rglob("*") if f.is_file()} == {"a.nii": b"3", "s/b.nii": b"2"}
    with pytest.raises(Exception, match="no file for"):
        ranges.write(table(("../x.nii", b"4")), str(tmp_path))


def test_runs():
    assert ranges.runs(np.array([0, 1, 2, 5, 6, 9]), 0, 10) == [(0, 3), (5, 7), (9, 10)]
    assert ranges.runs(np.array([0, 1, 2, 5, 6, 19]), 2, 4) == [(0, 4), (4, 7), (19, 20)]
    assert ranges.runs(np.array([], int), 1, 1) == []


def test_images_are_built_and_read_some_at_a_time(spark):
    rows = [(f"n{n}", t, i, None if (n, i) == (3, 5) else float(100 * n + 10 * t + i)) for n in range(40) for t in range(1 + n % 3) for i in range(8) if (n, i) != (4, 2)]
    table = spark.createDataFrame(rows, "img string, t int, i int, v double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)  # images go over the ends of batches
    try:
        files = nifti.encode(table, 2, 2, 2, "float64").selectExpr("img as path", "content", "cast(null as binary) as image")
        found = nifti.voxels_of(files)
        plans = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.img, r.t, r.i): r.v for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "MapInArrow" in plans and "FlatMapGroups" not in plans
    want = {r[:3]: r[3] for r in rows}
    assert len(got) == sum(8 * (1 + n % 3) for n in range(40))
    assert all(v == want[k] if want.get(k) is not None else np.isnan(v) for k, v in got.items())
