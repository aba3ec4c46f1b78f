"""Voxel tables: one row a voxel, (t, z, y, x, i, v) with i = x + nx (y + ny z), and what turns other tables into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_vectors(vectors: DataFrame, key: str, array: str, nx: int, ny: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's array as a volume, t its key; a null array gives no voxel."""
    long = vectors.select(F.col(key).alias("t"), *keep, F.posexplode(array).alias("i", "v"))
    return with_coordinates(long.withColumn("v", F.col("v").cast("double")), nx, ny)


def with_coordinates(voxels: DataFrame, nx: int, ny: int) -> DataFrame:
    return voxels.withColumns({"x": F.col("i") % nx, "y": F.expr(f"i div {nx}") % ny, "z": F.expr(f"i div {nx * ny}").cast("int")}).withColumn("y", F.col("y").cast("int"))


def index(x: Column, y: Column, z: Column, nx: int, ny: int) -> Column:
    return x + nx * (y + ny * z)


def blank(spark: SparkSession, nx: int, ny: int, nz: int, value: float = 0.0) -> DataFrame:
    """A new volume of one value."""
    return with_coordinates(spark.range(nx * ny * nz).select(F.lit(0).alias("t"), F.col("id").cast("int").alias("i"), F.lit(value).alias("v")), nx, ny)


def test_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as 4 x 4 x 4 volumes with their label."""
    return from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 4, 4, ("label",))


def cubes(spark: SparkSession, sf_dir: str, side: int = 32) -> DataFrame:
    """The embeddings, 64 values each, laid one after another into volumes of side^3 voxels; t counts these from 0."""
    each = side**3 // 64
    long = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr(f"vec_id div {each}").alias("t"), (F.col("vec_id") % each * 64).alias("_first"), F.posexplode("embedding").alias("_k", "v"))
    return with_coordinates(long.select("t", (F.col("_first") + F.col("_k")).cast("int").alias("i"), F.col("v").cast("double").alias("v")), side, side)


def plane(voxels: DataFrame, t: int) -> DataFrame:
    """One time point; the filter reaches the scan."""
    return voxels.where(F.col("t") == t)


def region(voxels: DataFrame, **bounds: tuple[int, int]) -> DataFrame:
    """Voxels whose coordinates lie in [first, first + size) of every named axis; size 1 collapses an axis."""
    for axis, (first, size) in bounds.items():
        voxels = voxels.where((F.col(axis) >= first) & (F.col(axis) < first + size))
    return voxels
