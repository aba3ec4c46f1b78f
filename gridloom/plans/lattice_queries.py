"""Queries on volumes of 32^3 voxels (the embeddings laid one after another) and on control grids, with their SQL.

A volume's last voxels may be absent; they count as 0. Floating sums are rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import arrival, bricks, distance, multigrid, nearest_field, splines, stencil, topology, warp, watershed
from gridloom.plans.registry import query, r
from gridloom.shared import scratch
from gridloom.sources import nifti, ranges
from gridloom.sources.voxels import cubes, region

SIDE = 16
CUBE = (32, 32, 32)

CUBE_SQL = """WITH cube AS MATERIALIZED (
    SELECT t, i % 32 AS x, i // 32 % 32 AS y, i // 1024 AS z, v
    FROM (SELECT vec_id // 512 AS t, (vec_id % 512 * 64 + u - 1)::INT AS i, embedding[u]::DOUBLE AS v FROM embeddings, generate_series(1, 64) g(u)))"""

#: The cubic B-spline and its derivative at a.
BASES_SQL = """base AS (SELECT k, c, CASE WHEN abs(a) < 1 THEN 2 / 3.0::DOUBLE + (abs(a) / 2 - 1) * a * a WHEN abs(a) < 2 THEN -pow(abs(a) - 2, 3) / 6 ELSE 0 END AS b,
        sign(a) * CASE WHEN abs(a) < 1 THEN (1.5::DOUBLE * abs(a) - 2) * abs(a) WHEN abs(a) < 2 THEN -pow(abs(a) - 2, 2) / 2 ELSE 0 END / {h} AS s
    FROM (SELECT k, c, k / {h}::DOUBLE - c AS a FROM generate_series(0, {n} - 1) p(k), generate_series(-1, ({n} - 1) // {h} + 2) q(c)) WHERE abs(a) < 2)"""


def small_grids(d: DataFrame, scale: float = 1.0) -> DataFrame:
    """Each 4 x 4 x 4 volume as a control grid; with spacing 5 it spans 5 x 5 x 5 voxels."""
    v = F.col("v") * scale
    return d.select("t", *[(F.col(a) - 1).alias(f"c{a}") for a in "xyz"], v.alias("ux"), (v * v).alias("uy"), (-v).alias("uz"))


GRID_SQL = "grid AS (SELECT t, x - 1 AS cx, y - 1 AS cy, z - 1 AS cz, v * {scale} AS ux, v * v * {scale} * {scale} AS uy, -v * {scale} AS uz FROM vox)"


@query(
    "grid_init",
    """SELECT t, cx::INT AS cx, cy::INT AS cy, cz::INT AS cz, round(0.1::DOUBLE * 8 * cx + 0.2::DOUBLE * 8 * cy + 3, 9) AS ux, round(-0.1::DOUBLE * 8 * cy - 1, 9) AS uy, round(0.3::DOUBLE * 8 * cx + 0.5::DOUBLE, 9) AS uz
    FROM (SELECT DISTINCT vec_id // 512 AS t FROM embeddings), generate_series(-1, 5) a(cx), generate_series(-1, 5) b(cy), generate_series(-1, 5) c(cz)""",
    raw=True,
)
def _grid_init(d, s, p, v):
    found = splines.grid(cubes(s, p), CUBE, 8, [[1.1, 0.2, 0, 3], [0, 0.9, 0, -1], [0.3, 0, 1, 0.5]])
    return found.select("t", "cx", "cy", "cz", *[r(u, 9).alias(u) for u in splines.MOVES])


@query(
    "grid_refined",
    f"""WITH {GRID_SQL.format(scale="1.0::DOUBLE")},
    tap AS (SELECT * FROM (VALUES (-2, 0.125::DOUBLE), (-1, 0.5), (0, 0.75), (1, 0.5), (2, 0.125)) k(d, w))
    SELECT t, (2 * cx + a.d)::INT AS cx, (2 * cy + b.d)::INT AS cy, (2 * cz + c.d)::INT AS cz,
           round(sum(ux * a.w * b.w * c.w), 9) AS ux, round(sum(uy * a.w * b.w * c.w), 9) AS uy, round(sum(uz * a.w * b.w * c.w), 9) AS uz
    FROM grid, tap a, tap b, tap c WHERE 2 * cx + a.d BETWEEN -1 AND 3 AND 2 * cy + b.d BETWEEN -1 AND 3 AND 2 * cz + c.d BETWEEN -1 AND 3 GROUP BY 1, 2, 3, 4""",
)
def _grid_refined(d, s, p, v):
    return splines.refined(small_grids(d)).select("t", "cx", "cy", "cz", *[r(u, 9).alias(u) for u in splines.MOVES])


@query(
    "spline_displacements",
    f"""WITH {GRID_SQL.format(scale="1.0::DOUBLE")}, {BASES_SQL.format(h=5, n=5)}
    SELECT t, a.k::INT AS x, b.k::INT AS y, e.k::INT AS z, round(sum(ux * a.b * b.b * e.b), 9) AS ux, round(sum(uy * a.b * b.b * e.b), 9) AS uy, round(sum(uz * a.b * b.b * e.b), 9) AS uz
    FROM grid JOIN base a ON a.c = cx JOIN base b ON b.c = cy JOIN base e ON e.c = cz GROUP BY 1, 2, 3, 4""",
)
def _spline_displacements(d, s, p, v):
    return splines.displacements(small_grids(d), (5, 5, 5), 5).select("t", "x", "y", "z", *[r(u, 9).alias(u) for u in splines.MOVES])


@query(
    "jacobian_penalty",
    f"""WITH {GRID_SQL.format(scale="20.0::DOUBLE")}, {BASES_SQL.format(h=5, n=5)},
    jac AS (SELECT t, 1 + sum(ux * a.s * b.b * e.b) AS xx, sum(ux * a.b * b.s * e.b) AS xy, sum(ux * a.b * b.b * e.s) AS xz,
                   sum(uy * a.s * b.b * e.b) AS yx, 1 + sum(uy * a.b * b.s * e.b) AS yy, sum(uy * a.b * b.b * e.s) AS yz,
                   sum(uz * a.s * b.b * e.b) AS zx, sum(uz * a.b * b.s * e.b) AS zy, 1 + sum(uz * a.b * b.b * e.s) AS zz
            FROM grid JOIN base a ON a.c = cx JOIN base b ON b.c = cy JOIN base e ON e.c = cz GROUP BY t, a.k, b.k, e.k),
    det AS (SELECT t, xx * (yy * zz - yz * zy) - xy * (yx * zz - yz * zx) + xz * (yx * zy - yy * zx) AS d FROM jac)
    SELECT t, round(avg(pow(ln(CASE WHEN d > 0 THEN d END), 2)), 6) AS penalty, round(min(d), 6) AS least, count(*) FILTER (NOT d > 0) AS folded FROM det GROUP BY t""",
)
def _jacobian_penalty(d, s, p, v):
    return splines.jacobian_penalty(small_grids(d, 20.0), (5, 5, 5), 5).select("t", r("penalty").alias("penalty"), r("least").alias("least"), "folded")


@query("grid_unfolded")
def _grid_unfolded(d, s, p, v):
    return splines.unfolded(small_grids(d, 12.0), (5, 5, 5), 5).select("t", "cx", "cy", "cz", *[r(u).alias(u) for u in splines.MOVES])


@query(
    "ssd_node_gradient",
    CUBE_SQL
    + ", "
    + BASES_SQL.format(h=8, n=32)
    + """, w AS (SELECT t, x, y, z, v, v * v AS w FROM cube),
    g AS (SELECT t, x, y, z, 2 * (w - v) / count(*) OVER (PARTITION BY t) AS d,
                 CASE WHEN x < 31 THEN coalesce(lead(w) OVER lx, 0) - w ELSE w - lag(w) OVER lx END AS gx,
                 CASE WHEN y < 31 THEN coalesce(lead(w) OVER ly, 0) - w ELSE w - lag(w) OVER ly END AS gy,
                 CASE WHEN z < 31 THEN coalesce(lead(w) OVER lz, 0) - w ELSE w - lag(w) OVER lz END AS gz
          FROM w WINDOW lx AS (PARTITION BY t, y, z ORDER BY x), ly AS (PARTITION BY t, x, z ORDER BY y), lz AS (PARTITION BY t, x, y ORDER BY z)),
    px AS (SELECT t, c AS cx, y, z, sum(d * gx * b) AS ux, sum(d * gy * b) AS uy, sum(d * gz * b) AS uz FROM g JOIN base ON k = x GROUP BY ALL),
    py AS (SELECT t, cx, c AS cy, z, sum(ux * b) AS ux, sum(uy * b) AS uy, sum(uz * b) AS uz FROM px JOIN base ON k = y GROUP BY ALL)
    SELECT t, cx::INT AS cx, cy::INT AS cy, c::INT AS cz, round(sum(ux * b), 10) AS ux, round(sum(uy * b), 10) AS uy, round(sum(uz * b), 10) AS uz FROM py JOIN base ON k = z
    GROUP BY t, cx, cy, c HAVING max(abs(ux * b)) + max(abs(uy * b)) + max(abs(uz * b)) > 0""",
    raw=True,
)
def _ssd_node_gradient(d, s, p, v):
    target = cubes(s, p)
    source = target.withColumn("v", F.col("v") * F.col("v"))
    found = splines.node_gradient(target, source, splines.grid(target, CUBE, 8), CUBE, 8, "ssd")
    return found.where(" or ".join(f"{u} <> 0" for u in splines.MOVES)).select("t", "cx", "cy", "cz", *[r(u, 10).alias(u) for u in splines.MOVES])


@query("nmi_node_gradient")
def _nmi_node_gradient(d, s, p, v):
    target = cubes(s, p).withColumn("v", F.greatest(F.lit(1.0), F.least(F.lit(28.0), F.col("v") * 40 + 15)))
    source = target.withColumn("v", F.greatest(F.lit(1.0), 29 - F.col("v")))
    found = splines.node_gradient(target, source, splines.grid(target, CUBE, 8), CUBE, 8, "nmi")
    return found.select("t", "cx", "cy", "cz", *[r(u, 8).alias(u) for u in splines.MOVES])


@query("ffd_optimised")
def _ffd(d, s, p, v):
    target = stencil.box_mean(cubes(s, p).select("t", "x", "y", "z", "v"), 2)
    source = target.withColumn("x", F.col("x") - 1).where("x >= 0")
    found = splines.optimise(target, source, splines.grid(target, CUBE, 8), CUBE, 8, "ssd", 1e-6)
    return found.select("t", "cx", "cy", "cz", *[r(u, 4).alias(u) for u in splines.MOVES])


@query("multigrid_solve")
def _multigrid(d, s, p, v):
    slopes = stencil.gradient(cubes(s, p)).select("t", "x", "y", "z", *[(F.col(f"g{a}") * 10).alias(f"g{a}") for a in "xyz"], "v")
    pairs = [("gx", "gx"), ("gy", "gy"), ("gz", "gz"), ("gx", "gy"), ("gx", "gz"), ("gy", "gz")]
    rows = slopes.select("t", "x", "y", "z", *[(F.col(a) * F.col(b)).alias(f"a{k}") for k, (a, b) in enumerate(pairs)], *[(-F.col("v") * F.col(g)).alias(f"b{g}") for g in ("gx", "gy", "gz")])
    pieces = bricks.bricks(rows, {"a": [f"a{k}" for k in range(6)], "b": ["bgx", "bgy", "bgz"]}, CUBE, SIDE)
    solved = multigrid.solve(pieces, multigrid.Regulariser("elastic", 1.0, 0.5, 1e-2), 6, 2, SIDE)
    return bricks.voxels(solved, {"u": ["ux", "uy", "uz"]}).select("t", "i", *[r(c, 4).alias(c) for c in ("ux", "uy", "uz")])


@query("warp_priors")
def _warp_priors(d, s, p, v):
    smooth = stencil.box_mean(cubes(s, p).select("t", "x", "y", "z", "v"), 2)
    split = smooth.select("t", "x", "y", "z", F.greatest(F.col("v"), F.lit(0.0)).alias("gm"), F.greatest(-F.col("v"), F.lit(0.0)).alias("wm"))
    moved = split.select("t", (F.col("x") - 1).alias("x"), "y", "z", F.col("gm").alias("pg"), F.col("wm").alias("pw")).where("x >= 0")
    found = warp.warp_priors(split.join(moved, ["t", "x", "y", "z"], "left"), ["gm", "wm"], ["pg", "pw"], CUBE, side=SIDE)
    return found.select("t", "i", *[r(c, 4).alias(c) for c in ("gm", "wm", "dx", "dy", "dz")])


def _shape_of(s, p) -> DataFrame:
    """Voxels of smoothed volumes that are above 0."""
    return stencil.box_mean(cubes(s, p).select("t", "x", "y", "z", "v"), 1).where("v > 0")


@query(
    "euler_number",
    CUBE_SQL
    + """, f AS (SELECT t, x, y, z FROM cube WHERE v > 0.05::DOUBLE),
    cell AS (SELECT DISTINCT t, 2 * x + a AS a, 2 * y + b AS b, 2 * z + c AS c FROM f, generate_series(-1, 1) i(a), generate_series(-1, 1) j(b), generate_series(-1, 1) k(c))
    SELECT t, sum(CASE WHEN (abs(a % 2) + abs(b % 2) + abs(c % 2)) % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS euler FROM cell GROUP BY t""",
    raw=True,
)
def _euler(d, s, p, v):
    return topology.euler_number(cubes(s, p).where(v > 0.05))


@query("thinned")
def _thinned(d, s, p, v):
    found = topology.thinned(topology.masks(_shape_of(s, p), CUBE, SIDE), SIDE)
    return bricks.voxels(found, {"m": ["m"]}).where("m > 0").select("t", "i")


@query("topological_erosion")
def _topological_erosion(d, s, p, v):
    found = topology.eroded(topology.masks(_shape_of(s, p), CUBE, SIDE), 1, SIDE)
    return bricks.voxels(found, {"m": ["m"]}).where("m > 0").select("t", "i")


@query(
    "exact_distance",
    CUBE_SQL
    + """, seed AS (SELECT * FROM cube WHERE v > 0.3::DOUBLE)
    SELECT c.t, c.x, c.y, c.z, round(sqrt(min((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) * 2.25::DOUBLE + (c.z - s.z) * (c.z - s.z))), 6) AS d
    FROM cube c LEFT JOIN seed s ON c.t = s.t GROUP BY ALL""",
    raw=True,
)
def _exact_distance(d, s, p, v):
    found = distance.exact_distance(cubes(s, p).withColumn("v", v - 0.3), (1.0, 1.5, 1.0))
    return found.select("t", "x", "y", "z", r("d").alias("d"))


# --- images written as files' bytes and read again: a volume is an image of its own, its values as the second of two times


def _images(d: DataFrame, kind: str) -> DataFrame:
    """(path, content, image) of the volumes, by the writer."""
    both = d.select(F.col("t").cast("string").alias("img"), F.explode(F.array(F.lit(0), F.lit(1))).alias("t"), "i", "v")
    values = F.when(F.col("t") == 0, F.round(F.col("v") * 20)).otherwise(F.col("v") if kind == "float32" else F.round(F.col("v") * 100))
    return nifti.encode(both.withColumn("v", values), 4, 4, 4, kind).select(F.col("img").alias("path"), "content", F.lit(None).cast("binary").alias("image"))


IMAGE_SQL = """SELECT t::VARCHAR AS img, u AS t, x, y, z, i, {v} + 0 AS v FROM vox, generate_series(0, 1) g(u)"""


@query("image_round_trip", IMAGE_SQL.format(v="CASE WHEN u = 0 THEN round(v * 20) ELSE v END").replace("u AS t", "u::INT AS t").replace(", i,", ", i::BIGINT AS i,"))
def _image_round_trip(d, s, p, v):
    return nifti.voxels_of(_images(d, "float32")).select("img", "t", "x", "y", "z", "i", "v")


@query("image_planes", "SELECT t::VARCHAR AS img, i::BIGINT AS i, round(v * 100) + 0 AS v FROM vox")
def _image_planes(d, s, p, v):
    return nifti.voxels_of(_images(d, "int16"), [1]).select("img", "i", "v")


@query("image_subregion", "SELECT t::VARCHAR AS img, x, y, z, v FROM vox WHERE x BETWEEN 1 AND 2 AND y = 3 AND z >= 2")
def _image_subregion(d, s, p, v):
    return region(nifti.voxels_of(_images(d, "float32"), [1]), x=(1, 2), y=(3, 1), z=(2, 2)).select("img", "x", "y", "z", "v")


@query(
    "image_headers",
    "SELECT DISTINCT vec_id::VARCHAR AS img, 4 AS nx, 4 AS ny, 4 AS nz, 2 AS nt, 1 AS nu, 1.0::DOUBLE AS dx, 'int16' AS datatype, 0.0::DOUBLE AS scl_slope, 'mm' AS units FROM embeddings WHERE embedding IS NOT NULL",
    raw=True,
)
def _image_headers(d, s, p, v):
    return nifti.headers_of(_images(d, "int16")).select("img", "nx", "ny", "nz", "nt", "nu", "dx", "datatype", "scl_slope", "units")


@query("image_ranges", "SELECT t::VARCHAR AS img, least(min(round(v * 20)), min(v)) + 0 AS low, greatest(max(round(v * 20)), max(v)) + 0 AS high FROM vox GROUP BY t")
def _image_ranges(d, s, p, v):
    images = _images(d, "float32")
    found = nifti.ranged(nifti.headers_of(images), nifti.voxels_of(images))
    return found.select("img", F.col("cal_min").alias("low"), F.col("cal_max").alias("high"))


def _files(s, p: str, kind: str = "float32") -> str:
    """A folder with the 32^3 volumes as image files, v * 1000 rounded where the type is a whole one."""
    d = cubes(s, p).select(F.concat(F.col("t").cast("string"), F.lit(".nii")).alias("img"), F.lit(0).alias("t"), "i", (F.col("v") if kind == "float32" else F.round(F.col("v") * 1000)).alias("v"))
    path = scratch(s)
    ranges.write(nifti.encode(d, *CUBE, kind), path)
    return path


@query("image_files_planes", CUBE_SQL + " SELECT t || '.nii' AS img, x::INT AS x, y::INT AS y, z::INT AS z, (x + 32 * y + 1024 * z)::BIGINT AS i, v FROM cube WHERE z BETWEEN 8 AND 11 AND y < 5", raw=True)
def _image_files_planes(d, s, p, v):
    found = ranges.voxels(s, _files(s, p), split_bytes=1 << 16).where("z between 8 and 11 and y < 5 and not isnan(v)")
    return found.select("img", "x", "y", "z", "i", "v")


@query("image_files_slices", CUBE_SQL + " SELECT t || '.nii' AS img, z::INT AS z, count(*) AS n, sum(round(v * 1000)) AS total, max(round(v * 1000)) AS most FROM cube WHERE z < 24 GROUP BY ALL", raw=True)
def _image_files_slices(d, s, p, v):
    found = ranges.voxels(s, _files(s, p, "float64"), split_bytes=1 << 16).where("z < 24 and not isnan(v)")
    return found.groupBy("img", "z").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.max("v").alias("most"))


@query("image_files_headers", "SELECT DISTINCT (vec_id // 512) || '.nii' AS img, 32 AS nx, 32 AS ny, 32 AS nz, 1 AS nt, 'float32' AS datatype, 1.0::DOUBLE AS dx FROM embeddings WHERE embedding IS NOT NULL", raw=True)
def _image_files_headers(d, s, p, v):
    return ranges.headers(s, _files(s, p)).select("img", "nx", "ny", "nz", "nt", "datatype", "dx")


def flood_markers(d: DataFrame) -> DataFrame:
    """Voxels with the label, by place, of every eighth voxel along each axis as marker."""
    inner = [F.col(a) % 8 == 4 for a in "xyz"]
    place = F.floor(F.col("x") / 8) + 4 * F.floor(F.col("y") / 8) + 16 * F.floor(F.col("z") / 8) + 1
    return d.withColumn("marker", F.when(inner[0] & inner[1] & inner[2], place))


@query("watershed_forest")
def _watershed_forest(d, s, p, v):
    found = watershed.watershed(flood_markers(cubes(s, p)))
    return found.select("t", "i", "label", r("level").alias("level"))


def timed(d: DataFrame) -> DataFrame:
    """Voxels with seeds where a value is high, and a speed that falls with it."""
    return d.select("t", "x", "y", "z", (F.col("v") - 0.3).alias("v"), F.exp(-4 * F.abs("v")).alias("speed"))


@query("travel_upwind")
def _travel_upwind(d, s, p, v):
    return arrival.travel_time(timed(cubes(s, p)), CUBE, "upwind", SIDE).select("t", "i", r("time").alias("time"))


@query("travel_faces")
def _travel_faces(d, s, p, v):
    return arrival.travel_time(timed(cubes(s, p)), CUBE, "faces", SIDE).select("t", "i", r("time").alias("time"))


def matched(d: DataFrame) -> DataFrame:
    """Each volume against all others (of 16^3 voxels, so that small tables hold several)."""
    return nearest_field.nearest_field(d, d.withColumnRenamed("t", "s"), apart=True)


@query("nearest_field")
def _nearest_field(d, s, p, v):
    return matched(cubes(s, p, 16)).select("t", "x", "y", "z", "rank", "s", "dx", "dy", "dz", r("distance").alias("distance"))


@query("nearest_field_labels")
def _nearest_field_labels(d, s, p, v):
    d = cubes(s, p, 16)
    labels = d.select(F.col("t").alias("s"), "x", "y", "z", (v > 0).cast("int").alias("label"))
    return nearest_field.voted(matched(d), labels).select("t", "x", "y", "z", "label", r("share").alias("share"))
