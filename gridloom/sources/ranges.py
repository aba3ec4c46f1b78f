"""NIfTI and ANALYZE files by byte ranges: a data source whose tasks read a header and their own part of a file.

A file is cut every split_bytes; a task reads the header (348 bytes) and then those rows of voxels that begin in its range. Filters
on img leave files out before tasks are made; filters on u, t, z, y and i choose the rows, and only these are read (gaps under GAP
bytes are read over). So one plane of a large series costs its own bytes, and a file of any size is read by many tasks, none
holding more than CHUNK voxels. The header view reads headers only. A .gz file has no places to start at, so it is one task, read as
a stream. Files are opened by pyarrow: local paths and the stores that it knows (s3, gs, abfs, hdfs); others go through nifti.voxels.

The writer puts each row (img, content) of a table into a file of its own. A file is moved into place when it is whole, so tasks
that are lost or run twice do no harm; files of other names stay.
"""

from __future__ import annotations

import fnmatch
import gzip
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from gridloom.sources.nifti import HEADER, VOXELS, layout

SPLIT, GAP, CHUNK, HEADERS = 64 << 20, 1 << 16, 1 << 20, 256
#: What a filter of each kind leaves of an array of values.
_TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, In: lambda values, wanted: np.isin(values, [w for w in wanted if w is not None])}
_PLACES = ("u", "t", "z", "y", "i")


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """Files (full path, name), and of a single one the bytes from start to end."""

    files: list[tuple[str, str]]
    start: int = 0
    end: int = 1 << 62


class _File:
    """Bytes by place of a plain or zipped file; places ascend."""

    def __init__(self, store, path: str) -> None:
        self.path, self.plain = path, store.open_input_file(path)
        self.file = gzip.GzipFile(fileobj=self.plain) if path.endswith(".gz") else self.plain

    def at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        found = self.file.read(size)
        if len(found) < size:
            raise ValueError(f"{self.path}: ends before byte {place + size}")
        return found

    def __enter__(self) -> "_File":
        return self

    def __exit__(self, *_) -> None:
        self.file.close()
        self.plain.close()


def runs(wanted: np.ndarray, gap: int, most: int) -> list[tuple[int, int]]:
    """Stretches [first, end) that cover all wanted numbers (ascending), with holes of at most gap, each at most most long."""
    if not len(wanted):
        return []
    after = np.flatnonzero(np.diff(wanted) > gap + 1)
    out = []
    for first, last in zip(wanted[np.r_[0, after + 1]].tolist(), wanted[np.r_[after, len(wanted) - 1]].tolist(), strict=True):
        out += [(k, min(k + most, last + 1)) for k in range(first, last + 1, most)]
    return out


class RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*.nii*")
        self.view, self.split = options.get("view", "voxels"), int(options.get("split_bytes", SPLIT))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        """Keeps what can be told from places and names; Spark evaluates all filters again."""
        for one in filters:
            name = ".".join(getattr(one, "attribute", ()))
            if type(one) in _TESTS and name in (*_PLACES, "img") and getattr(one, "value", None) is not None:
                self.tests.append((name, type(one), one.value))
            yield one

    def _passes(self, name: str, values: np.ndarray) -> np.ndarray:
        keep = np.ones(len(values), bool)
        for column, kind, value in self.tests:
            if column == name:
                keep &= _TESTS[kind](values, value)
        return keep

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        infos = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern)]
        infos.sort(key=lambda f: f.path)
        names = [f.path[len(root.rstrip("/")) + 1 :] for f in infos]
        kept = [(f, n) for f, n, keep in zip(infos, names, self._passes("img", np.array(names, object)), strict=True) if keep]
        if self.view == "headers":
            found = [(f.path, n) for f, n in kept]
            return [Part(found[k : k + HEADERS]) for k in range(0, len(found), HEADERS)] or [Part([])]
        parts = []
        for f, name in kept:
            step = f.size if f.path.endswith(".gz") else self.split
            parts += [Part([(f.path, name)], at, at + step if at + step < f.size else 1 << 62) for at in range(0, max(f.size, 1), max(step, 1))]
        return parts or [Part([])]

    def read(self, partition: Part):
        import pyarrow as pa

        store, _ = _store(self.path)
        for path, name in partition.files:
            with _File(store, path) as file:
                if self.view == "headers":
                    head = layout(name, file.at(0, 348))[0]
                    yield pa.RecordBatch.from_pylist([head], _arrow(HEADER))
                else:
                    yield from self._voxels(file, store, name, partition)

    def _voxels(self, file: _File, store, name: str, part: Part):
        # the header of a pair stands in the file of the same name that ends in .hdr
        stem, other = file.path.removesuffix(".gz"), file
        if stem.endswith(".img"):
            ends = ".hdr.gz" if file.path.endswith(".gz") else ".hdr"
            other = _File(store, stem[:-4] + ends)
        head, kind, sizes, at, alone = layout(name, other.at(0, 348))
        if other is not file:
            other.__exit__()
        elif not alone:
            return  # a header of a pair
        nx, ny, nz, nt, nu = sizes
        width = nx * kind.itemsize
        first, end = (int(np.clip(-(-(place - at) // width), 0, ny * nz * nt * nu)) for place in (part.start, part.end))
        rows = np.arange(first, end)
        for column, values in self._places(rows, sizes).items():
            rows = rows[self._passes(column, values(rows))]
        for low, high in runs(rows, GAP // width, max(CHUNK // nx, 1)):
            v = np.frombuffer(file.at(at + low * width, (high - low) * width), kind).astype(float).reshape(-1, nx)
            here = rows[slice(*np.searchsorted(rows, [low, high]))]
            yield self._batch(name, here, v[here - low], sizes, head)

    def _places(self, rows: np.ndarray, sizes: list[int]) -> dict:
        nx, ny, nz, nt, _ = sizes
        return {"u": lambda r: r // (ny * nz * nt), "t": lambda r: r // (ny * nz) % nt, "z": lambda r: r // ny % nz, "y": lambda r: r % ny}

    def _batch(self, name: str, rows: np.ndarray, v: np.ndarray, sizes: list[int], head: dict):
        import pyarrow as pa

        nx, ny, nz = sizes[:3]
        if head["scl_slope"]:
            v = v * head["scl_slope"] + head["scl_inter"]
        columns = {c: np.repeat(f(rows), nx).astype(np.int32) for c, f in self._places(rows, sizes).items()}
        columns["x"] = np.tile(np.arange(nx, dtype=np.int32), len(rows))
        columns["i"] = (np.repeat(rows % (ny * nz), nx) * nx + columns["x"]).astype(np.int64)
        columns |= {"img": pa.array([name]).take(pa.array(np.zeros(v.size, np.int32))), "v": v.ravel()}
        form = _arrow(VOXELS)
        return pa.RecordBatch.from_arrays([pa.array(columns[c]) if c != "img" else columns[c] for c in form.names], schema=form)


def _arrow(ddl: str):
    """The Arrow schema of a flat DDL text."""
    import pyarrow as pa

    plain = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    return pa.schema([(name, plain[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("img").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if name is None or content is None or not name.strip("/") or ".." in name.split("/"):
                    raise ValueError(f"no file for {name!r}")
                folder, _, base = f"{root.rstrip('/')}/{name}".rpartition("/")
                store.create_dir(folder, recursive=True)
                aside = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(aside) as out:
                    out.write(content)
                store.move(aside, f"{folder}/{base}")
        return WriterCommitMessage()


class VolumeFiles(DataSource):
    """Format gridloom_volumes. Options: path, pattern (*.nii*), view (voxels or headers), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_volumes"

    def schema(self) -> str:
        return HEADER if self.options.get("view") == "headers" else VOXELS

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def _source(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeFiles)


def voxels(spark: SparkSession, path: str, pattern: str = "*.nii*", split_bytes: int = SPLIT) -> DataFrame:
    """Voxel rows (img, the file's name under path, u, t, z, y, x, i, v) of the matching files of a folder and those below it,
    scaled by slope and intercept where the slope is not 0; for pairs, the pattern names the .img files."""
    _source(spark)
    return spark.read.format("gridloom_volumes").options(path=path, pattern=pattern, view="voxels", split_bytes=split_bytes).load()


def headers(spark: SparkSession, path: str, pattern: str = "*.nii*") -> DataFrame:
    """One row a file, from its first 348 bytes."""
    _source(spark)
    return spark.read.format("gridloom_volumes").options(path=path, pattern=pattern, view="headers").load()


def write(files: DataFrame, path: str) -> None:
    """Every row (img, content) as file img under path; a file of that name is replaced."""
    _source(files.sparkSession)
    files.select("img", "content").write.format("gridloom_volumes").mode("append").options(path=path).save()
