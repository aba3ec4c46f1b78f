"""Merging, splitting, cutting and turning of lattices: coordinate arithmetic only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.voxels import index

#: Labels of an image that may be made dense.
MOST_LABELS = 1024


def merge(images: list[DataFrame]) -> DataFrame:
    """Single images one after another along t."""
    return reduce(DataFrame.unionByName, [d.withColumn("t", F.lit(k)) for k, d in enumerate(images)])


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """second's volumes after first's along t, each keeping its order."""
    last = first.agg(F.max("t")).first()[0]
    start = (second.agg(F.min("t")).first()[0] or 0) if "t" in second.columns else 0
    names = [c for c in ("t", "z", "y", "x", "i", "v") if c in first.columns]
    moved = (second if "t" in second.columns else second.withColumn("t", F.lit(0))).withColumn("t", F.col("t") + F.lit((-1 if last is None else last) + 1 - start))
    return first.select(*names).unionByName(moved.select(*names))


def select_plane(voxels: DataFrame, t: int) -> DataFrame:
    return voxels.where(F.col("t") == t).drop("t")


def split_labels(voxels: DataFrame) -> DataFrame:
    """One plane for each label from 0 to the largest (plane column label), 1 inside, 0 outside; more than MOST_LABELS are an error."""
    top = voxels.agg(F.max(F.round("v"))).first()[0]
    if top is None or top < 0:
        return voxels.withColumn("label", F.lit(0)).limit(0)
    if top > MOST_LABELS:
        raise ValueError(f"{int(top)} labels are more than {MOST_LABELS}")
    planes = voxels.withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(int(top)))))
    return planes.withColumn("v", (F.round("v") == F.col("label")).cast("double"))


def split_interleaved(voxels: DataFrame, axis: str) -> DataFrame:
    """Even and odd slices as part 0 and 1 of half the extent."""
    return voxels.withColumns({"part": F.col(axis) % 2, axis: F.expr(f"{axis} div 2").cast("int")})


def join_interleaved(voxels: DataFrame, axis: str) -> DataFrame:
    return voxels.withColumn(axis, 2 * F.col(axis) + F.col("part")).drop("part")


def pad(voxels: DataFrame, n: int, nx: int, ny: int, nz: int) -> DataFrame:
    """A border of n NaN voxels on every side of dense volumes: the border's rows are made from each volume's t, without a join."""
    mx, my, mz = nx + 2 * n, ny + 2 * n, nz + 2 * n
    whole = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    edge = lambda c, m: (F.col(c) < n) | (F.col(c) >= m - n)
    rim = F.filter(whole(mx), lambda x: (x < n) | (x >= mx - n))
    border = voxels.select("t").distinct().withColumn("z", F.explode(whole(mz))).withColumn("y", F.explode(whole(my)))
    border = border.withColumn("x", F.explode(F.when(edge("z", mz) | edge("y", my), whole(mx)).otherwise(rim))).withColumn("v", F.lit(float("nan")))
    moved = voxels.select("t", *[(F.col(a) + n).cast("int").alias(a) for a in "zyx"], "v")
    return moved.unionByName(border).withColumn("i", index(F.col("x"), F.col("y"), F.col("z"), mx, my).cast("int"))


def crop(voxels: DataFrame, n: int, nx: int, ny: int, nz: int) -> DataFrame:
    inside = voxels.where(f"x >= {n} and x < {nx - n} and y >= {n} and y < {ny - n} and z >= {n} and z < {nz - n}")
    moved = inside.withColumns({a: F.col(a) - n for a in "xyz"})
    return moved.withColumn("i", index(F.col("x"), F.col("y"), F.col("z"), nx - 2 * n, ny - 2 * n))


def subsample(voxels: DataFrame, axes: str = "xyz", step: int = 2) -> DataFrame:
    """Every step-th voxel of the named axes."""
    for a in axes:
        voxels = voxels.where(F.col(a) % step == 0)
    return voxels.withColumns({a: F.expr(f"{a} div {step}").cast("int") for a in axes})


def flip(voxels: DataFrame, axis: str, extent: int) -> DataFrame:
    return voxels.withColumn(axis, extent - 1 - F.col(axis))


def swap_time_and_component(voxels: DataFrame) -> DataFrame:
    return voxels.select(*[F.col(c).alias({"t": "u", "u": "t"}.get(c, c)) for c in voxels.columns])


def relabel(voxels: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Values of the mapping replaced, others kept."""
    pairs = F.create_map(*[F.lit(float(x)) for kv in mapping.items() for x in kv])
    return voxels.withColumn("v", F.coalesce(F.try_element_at(pairs, F.col("v")), F.col("v")))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coordinates that both masks hold."""
    keys = [F.col(c) for c in ("t", "i")]
    return a.where("v > 0").select(*keys).intersect(b.where("v > 0").select(*keys))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [F.col(c) for c in ("t", "i")]
    return a.where("v > 0").select(*keys).exceptAll(b.where("v > 0").select(*keys))
