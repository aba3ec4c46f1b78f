"""NIfTI-1 and ANALYZE 7.5 files as tables: header rows, voxel rows, and the way back.

Files are read with Spark's binaryFile source, so any store Spark opens will do, and decoded in numpy, one file a row.
Both byte orders, .gz and the numeric types below are known; complex and colour types are refused.
"""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: type code to name and numpy type.
TYPES = {2: ("uint8", "u1"), 4: ("int16", "i2"), 8: ("int32", "i4"), 16: ("float32", "f4"), 64: ("float64", "f8"), 256: ("int8", "i1"), 512: ("uint16", "u2"), 768: ("uint32", "u4"), 1024: ("int64", "i8")}
UNITS = {0: "unknown", 1: "m", 2: "mm", 3: "um", 8: "s", 16: "ms", 24: "us"}
XFORMS = {0: "unknown", 1: "scanner", 2: "aligned", 3: "talairach", 4: "mni152"}

HEADER = (
    "img string, nx int, ny int, nz int, nt int, nu int, dx double, dy double, dz double, dt double, datatype string, scl_slope double, scl_inter double, "
    "cal_min double, cal_max double, qform_code int, sform_code int, sto_xyz array<array<double>>, qto_xyz array<array<double>>, descrip string, intent_code int, units string"
)
#: Rows of a batch of voxels, of as many images as that holds.
CHUNK = 1 << 16
VOXELS = "img string, u int, t int, z int, y int, x int, i long, v double"


def quaternion_matrix(b: float, c: float, d: float, offset, spacing, sign: float) -> list[list[float]]:
    """4 x 4 matrix of a unit quaternion's vector part, an offset, spacings and the handedness of z."""
    a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
    q = np.array([a, b, c, d]) / max(1e-12, np.sqrt(a * a + b * b + c * c + d * d))
    a, b, c, d = q
    turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
    out = np.eye(4)
    out[:3, :3] = turn * (np.array(spacing) * [1, 1, sign])
    out[:3, 3] = offset
    return out.tolist()


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parse(name: str, data: bytes, image: bytes | None = None) -> tuple[dict, np.ndarray | None]:
    """Header fields and the voxels (u, t, z, y, x), unscaled; None where the data stand in another file, unless its bytes
    are given as image."""
    data = _plain(data)
    head, kind, sizes, at, alone = layout(name, data)
    if not alone:
        if image is None:
            return head, None
        data = _plain(image)
    return head, np.frombuffer(data, kind, int(np.prod(sizes)), at).reshape(sizes[::-1])


def layout(name: str, data: bytes) -> tuple[dict, np.dtype, list[int], int, bool]:
    """Header fields from a file's first 348 bytes or more; the voxels' type, sizes (x first) and first byte, and whether
    they stand in the same file."""
    if len(data) < 348:
        raise ValueError(f"{name}: shorter than a header")
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348:
        raise ValueError(f"{name}: not a NIfTI-1 or ANALYZE header")
    get = lambda form, at: struct.unpack_from(order + form, data, at)
    dim = get("8h", 40)
    sizes = [max(1, dim[k]) if k <= dim[0] else 1 for k in range(1, 6)]
    code = get("h", 70)[0]
    if code not in TYPES:
        raise ValueError(f"{name}: type {code} is not numeric")
    pixdim = get("8f", 76)
    magic = data[344:347]
    nifti = magic in (b"n+1", b"ni1")
    slope, inter = get("2f", 112) if nifti else (0.0, 0.0)
    quat = get("6f", 256) if nifti else (0.0,) * 6
    rows = [list(map(float, get("4f", at))) for at in (280, 296, 312)] if nifti else [[0.0] * 4] * 3
    head = {
        "img": name, "nx": sizes[0], "ny": sizes[1], "nz": sizes[2], "nt": sizes[3], "nu": sizes[4], "dx": pixdim[1], "dy": pixdim[2], "dz": pixdim[3], "dt": pixdim[4], "datatype": TYPES[code][0], "scl_slope": slope, "scl_inter": inter,
        "cal_max": get("f", 124)[0], "cal_min": get("f", 128)[0], "qform_code": get("h", 252)[0] if nifti else 0, "sform_code": get("h", 254)[0] if nifti else 0, "sto_xyz": [*rows, [0.0, 0.0, 0.0, 1.0]],
        "qto_xyz": quaternion_matrix(*quat[:3], quat[3:], pixdim[1:4], -1.0 if pixdim[0] < 0 else 1.0), "descrip": data[148:228].split(b"\0")[0].decode("latin-1"), "intent_code": get("h", 68)[0] if nifti else 0, "units": UNITS.get(data[123] & 7, "unknown") if nifti else "unknown",
    }
    alone = magic == b"n+1"
    at = max(352 if alone else 0, int(get("f", 108)[0]))
    return head, np.dtype(TYPES[code][1]).newbyteorder(order), sizes, at, alone


def build(volume: np.ndarray, datatype: str = "float32", slope: float = 0.0, inter: float = 0.0, spacing=(1.0, 1.0, 1.0), sform=None, descrip: str = "") -> bytes:
    """A single-file NIfTI-1 image of an array (z, y, x), (t, z, y, x) or (u, t, z, y, x); whole-number types are scaled to
    their whole range where slope is 0 and the values are not whole, as they are otherwise."""
    code, kind = next((k, v[1]) for k, v in TYPES.items() if v[0] == datatype)
    values = np.asarray(volume, float)
    sizes = list(values.shape[::-1]) + [1] * (5 - values.ndim)
    if np.dtype(kind).kind in "iu":
        if slope == 0 and not np.array_equal(values, np.round(values)):
            low, high = np.nanmin(values), np.nanmax(values)
            info = np.iinfo(kind)
            slope = (high - low) / (float(info.max) - float(info.min)) or 1.0
            inter = low - slope * float(info.min)
            values = (values - inter) / slope
        info = np.iinfo(kind)
        values = np.clip(np.floor(np.nan_to_num(values) + 0.5), info.min, info.max)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    rank = max(k + 1 for k in range(5) if sizes[k] > 1 or k < 3)
    struct.pack_into("<8h", head, 40, rank, *sizes, 1, 1)
    struct.pack_into("<hh", head, 70, code, np.dtype(kind).itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", head, 108, 352.0, slope, inter)
    head[123] = 2 | 8
    head[148 : 148 + len(descrip[:79])] = descrip[:79].encode("latin-1", "replace")
    rows = sform or [[spacing[0], 0, 0, 0], [0, spacing[1], 0, 0], [0, 0, spacing[2], 0]]
    struct.pack_into("<hh", head, 252, 0, 1)
    for k in range(3):
        struct.pack_into("<4f", head, 280 + 16 * k, *rows[k][:4])
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype("<" + kind).tobytes()


def files(spark: SparkSession, path: str, pattern: str = "*.nii*", deep: bool = False) -> DataFrame:
    """Matching files of a folder (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(path)


def pairs(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """Header files with their image files: (path of the header, content, image); names differ in .hdr and .img (or .gz of these) only."""
    stem = lambda c: F.regexp_replace(c, r"\.(hdr|img)(\.gz)?$", "")
    heads = files(spark, path, "*.hdr*", deep).select("path", "content", stem("path").alias("_stem"))
    images = files(spark, path, "*.img*", deep).select(F.col("content").alias("image"), stem("path").alias("_stem"))
    return heads.join(images, "_stem").drop("_stem")


def headers(spark: SparkSession, path: str, pattern: str = "*.nii*") -> DataFrame:
    """One row a file, of any store that Spark opens; ranges.headers reads no more than the headers."""
    return headers_of(files(spark, path, pattern).select("path", "content"))


def headers_of(images: DataFrame) -> DataFrame:
    """One row for each image of (path, content)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([parse(p, bytes(c))[0] for p, c in zip(pdf.path, pdf.content, strict=True)])

    return images.select("path", "content").mapInPandas(run, HEADER)


def voxels(spark: SparkSession, path: str, pattern: str = "*.nii*", times: list[int] | None = None) -> DataFrame:
    """Voxel rows of all files, scaled by slope and intercept where the slope is not 0; times turns these planes only into
    rows. A pattern that ends in .hdr reads pairs of header and image files."""
    if pattern.endswith((".hdr", ".hdr.gz", ".hdr*")):
        return voxels_of(pairs(spark, path), times)
    return voxels_of(files(spark, path, pattern).select("path", "content", F.lit(None).cast("binary").alias("image")), times)


def voxels_of(images: DataFrame, times: list[int] | None = None) -> DataFrame:
    """Voxel rows of images (path, content, image: null, or the voxels' bytes where content is a header only)."""

    def batch_of(made: list[tuple]):
        import pyarrow as pa

        # (name, u, t, places z y x, values) of each plane of time
        sizes = [len(m[4]) for m in made]
        columns = [pa.array([m[0] for m in made], pa.string()).take(pa.array(np.repeat(np.arange(len(made)), sizes)))]
        columns += [pa.array(np.repeat(np.array([m[k] for m in made], np.int32), sizes)) for k in (1, 2)]
        columns += [pa.array(np.concatenate([m[3][k] for m in made])) for k in range(4)]
        columns.append(pa.array(np.concatenate([m[4] for m in made])))
        return pa.RecordBatch.from_arrays(columns, ["img", "u", "t", "z", "y", "x", "i", "v"])

    def run(batches):
        made, rows, shape, places = [], 0, None, None
        for batch in batches:
            for name, content, image in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "image")), strict=True):
                head, data = parse(name, content, image)
                if data is None:
                    raise ValueError(f"{name}: the voxels stand in another file")
                nu, nt, nz, ny, nx = data.shape
                if shape != (nz, ny, nx):
                    shape, i = (nz, ny, nx), np.arange(nz * ny * nx)
                    places = [*(c.astype(np.int32) for c in (i // (nx * ny), i // nx % ny, i % nx)), i]
                for u in range(nu):
                    for t in times if times is not None else range(nt):
                        v = data[u, t].astype(float).ravel()
                        if head["scl_slope"]:
                            v = v * head["scl_slope"] + head["scl_inter"]
                        made.append((name, u, t, places, v))
                        rows += v.size
                        if rows >= CHUNK:
                            yield batch_of(made)
                            made, rows = [], 0
        if made:
            yield batch_of(made)

    return images.select("path", "content", "image").mapInArrow(run, VOXELS)


def encode(table: DataFrame, nx: int, ny: int, nz: int, datatype: str = "float32", heads: DataFrame | None = None) -> DataFrame:
    """(img, content): one NIfTI file's bytes for each img of a voxel table (img, t, i, v); heads (as of headers()) gives spacing,
    orientation and description of the images that it holds, values being stored as they are."""
    own, known = ["dx", "dy", "dz", "sto_xyz", "descrip"], heads is not None

    def built(parts: list[dict]) -> bytes:
        t, i, v = (np.concatenate([p[c] for p in parts]) for c in ("t", "i", "v"))
        nt = int(t.max()) + 1
        out = np.full(nt * nx * ny * nz, np.nan)
        out[t * nx * ny * nz + i] = v
        head = {}
        if known and parts[0]["head"]["descrip"] is not None:
            first = parts[0]["head"]
            head = {"spacing": (first["dx"], first["dy"], first["dz"]), "sform": [list(map(float, r)) for r in first["sto_xyz"]], "descrip": first["descrip"]}
        return build(out.reshape(nt, nz, ny, nx), datatype, **head)

    def run(batches):
        import pyarrow as pa

        # rows come sorted by img; the last image of a batch may go on in the next
        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column("img").dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist()]
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "i", "v")}
            column["t"] = column["t"].astype(np.int64)
            names, contents = [], []
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                part = {c: x[start:end] for c, x in column.items()} | {"img": batch.column("img")[start].as_py()}
                part["head"] = {c: batch.column(c)[start].as_py() for c in own} if known else {}
                if held and held[0]["img"] != part["img"]:
                    names.append(held[0]["img"])
                    contents.append(built(held))
                    held = []
                held.append(part)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["img", "content"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]["img"]], pa.string()), pa.array([built(held)], pa.binary())], ["img", "content"])

    rows = table.select("img", "t", "i", "v")
    if heads is not None:
        rows = rows.join(heads.select("img", *own), "img", "left")
    return rows.repartition("img").sortWithinPartitions("img").mapInArrow(run, "img string, content binary")


def ranged(heads: DataFrame, table: DataFrame) -> DataFrame:
    """heads with cal_min and cal_max from the least and largest value of each image's voxels (img, v)."""
    found = table.where(~F.isnan("v")).groupBy("img").agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    return heads.join(found, "img", "left").withColumns({"cal_min": F.coalesce("_low", "cal_min"), "cal_max": F.coalesce("_high", "cal_max")}).drop("_low", "_high")


def unscaled(heads: DataFrame) -> DataFrame:
    """heads with a slope of 1 and an intercept of 0."""
    return heads.withColumns({"scl_slope": F.lit(1.0), "scl_inter": F.lit(0.0)})


def with_header_of(table: DataFrame, img: str) -> DataFrame:
    """The voxels of a table (img, ...) under the name, and so the header row, of another image."""
    return table.withColumn("img", F.lit(img))


def header_lines(heads: DataFrame) -> DataFrame:
    """(img, json): each header as a line of JSON."""
    return heads.select("img", F.to_json(F.struct(*heads.columns)).alias("json"))


def intlist(text: str) -> list[int]:
    """Whole numbers of a selector such as "3,5..9(2)"."""
    out: list[int] = []
    for part in text.strip("[]{} ").split(","):
        span, _, step = part.partition("(")
        first, dots, last = span.partition("..")
        out += range(int(first), int(last) + 1, int(step.rstrip(")") or 1) if step else 1) if dots else [int(first)]
    return out


def read_matrix(spark: SparkSession, path: str) -> list[list[float]]:
    """A 4 x 4 matrix from a text file of numbers."""
    numbers = [float(x) for r in spark.read.text(path, wholetext=True).collect() for x in r[0].split()]
    if len(numbers) != 16:
        raise ValueError("a matrix has 16 numbers")
    return [numbers[4 * r : 4 * r + 4] for r in range(4)]


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """Lines "image mask label" parted by blanks, commas, semicolons or tabs."""
    part = F.split(F.trim("value"), "[ ,;\t]+")
    return spark.read.text(path).where("length(trim(value)) > 0").select(part[0].alias("image"), part[1].alias("mask"), part[2].alias("label"))


def write_scores(scores: DataFrame, path: str) -> None:
    """filename;z-score rows with a header line."""
    scores.write.option("sep", ";").option("header", True).mode("overwrite").csv(path)


def joined_line(table: DataFrame, order: str, value: str) -> DataFrame:
    """All values in one comma-joined line; for tables of labels, at most 1025 rows."""
    return table.agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string"))).alias("value"))
