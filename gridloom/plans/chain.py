"""A list of operations as one lazy plan: ["-thr", "0.5", "-bin", "-dil", "1"] on a voxel table.

Steps that need a volume's size read it off the coordinates. Consecutive voxelwise steps collapse into one projection. An unknown step or a wrong argument fails before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import voxelwise as vx
from gridloom.operators import components, reshape, stats, stencil
from gridloom.sources.voxels import index

Image = DataFrame


def _pair(op: str) -> Callable:
    def step(d: DataFrame, arg: str, images: dict[str, Image]) -> DataFrame:
        if arg in images:
            other = images[arg].select("i", F.col("v").alias("_w"))
            return d.join(other, "i").withColumn("v", vx.combine(op, F.col("v"), F.col("_w"))).drop("_w")
        return d.withColumn("v", vx.combine(op, F.col("v"), F.lit(float(arg))))

    return step


def _map(f: Callable) -> Callable:
    return lambda d: d.withColumn("v", f(F.col("v")))


def _map1(f: Callable) -> Callable:
    return lambda d, a, _: d.withColumn("v", f(F.col("v"), float(a)))


def _shape(d: DataFrame) -> tuple[int, int, int]:
    return tuple((n or 0) + 1 for n in d.agg(*[F.max(a) for a in "xyz"]).first())


def _over_time(value) -> Callable:
    return lambda d: d.groupBy("x", "y", "z", "i").agg(value().cast("double").alias("v")).withColumn("t", F.lit(0))


def _flip(axis: str) -> Callable:
    def step(d: DataFrame) -> DataFrame:
        shape = _shape(d)
        turned = reshape.flip(d, axis, shape["xyz".index(axis)])
        return turned.withColumn("i", index(F.col("x"), F.col("y"), F.col("z"), shape[0], shape[1]).cast("int"))

    return step


def _components(connect: int) -> Callable:
    """The rank of each voxel's component by size, 1 the largest; 0 outside."""

    def step(d: DataFrame) -> DataFrame:
        found = components.components(d, connect).select("t", "i", "component")
        sizes = found.groupBy("t", "component").agg(F.count("i").alias("_n"))
        ranks = sizes.withColumn("_r", F.row_number().over(Window.partitionBy("t").orderBy(F.col("_n").desc(), "component")))
        return d.join(found.join(ranks, ["t", "component"]).select("t", "i", "_r"), ["t", "i"], "left").withColumn("v", F.coalesce("_r", F.lit(0)).cast("double")).drop("_r")

    return step


def _split_labels(d: DataFrame) -> DataFrame:
    if d.select("t").distinct().limit(2).count() > 1:
        raise ValueError("-splitlab takes one volume")
    return reshape.split_labels(d.drop("label")).withColumn("t", F.col("label")).drop("label")


def _merge(d: DataFrame, arg: str, images: dict[str, Image]) -> DataFrame:
    return reshape.append(d, images[arg])


def _geodesic(d: DataFrame, arg: str, images: dict[str, Image]) -> DataFrame:
    speed = images[arg].select("i", F.col("v").alias("speed")) if arg in images else None
    timed = d.join(speed, "i") if speed is not None else d.withColumn("speed", F.lit(float(arg)))
    return components.signed_geodesic(timed).drop("speed")


#: Steps without, with one and with two arguments.
PLAIN: dict[str, Callable] = {
    "-sqrt": _map(F.sqrt), "-exp": _map(F.exp), "-log": _map(vx.log), "-recip": _map(vx.recip), "-abs": _map(F.abs), "-bin": _map(vx.binarise), "-removenan": _map(vx.remove_nan), "-isnan": _map(vx.is_nan),
    "-otsu": lambda d: d.join(stats.otsu(d).select("t", F.col("bin").alias("_b")), "t").join(d.groupBy("t").agg(F.min("v").alias("_l"), F.max("v").alias("_h")), "t").withColumn("v", (F.col("v") > F.col("_l") + (F.col("_b") + 1) * (F.col("_h") - F.col("_l")) / 256).cast("double")).drop("_b", "_l", "_h"),
    "-z": stats.z_scored, "-tmean": _over_time(lambda: F.avg("v")), "-tmax": _over_time(lambda: F.max("v")), "-tmin": _over_time(lambda: F.min("v")), "-tpmax": _over_time(lambda: F.min_by("t", F.struct(-F.col("v"), F.col("t")))),
    "-flipimgx": _flip("x"), "-flipimgy": _flip("y"), "-flipimgz": _flip("z"), "-splitlab": _split_labels, "-concomp6": _components(6), "-concomp26": _components(26),
    "-lconcomp": lambda d: _components(6)(d).withColumn("v", (F.col("v") == 1).cast("double")), "-fill": lambda d: components.fill_holes(d, *_shape(d)), "-euc": lambda d: components.signed_distance(d).withColumn("v", F.col("d")).drop("d"),
    "-subsamp2": lambda d: reshape.subsample(stencil.gaussian(d, 0.5)), "-subsamp2xy": lambda d: reshape.subsample(d, "xy"), "-4to5": lambda d: reshape.swap_time_and_component(d if "u" in d.columns else d.withColumn("u", F.lit(0))),
}
ONE: dict[str, Callable] = {
    **{f"-{op}": _pair(op) for op in ("mul", "add", "sub", "div", "min")}, "-pow": _map1(lambda v, a: F.pow(v, F.lit(a))), "-thr": _map1(vx.threshold), "-uthr": _map1(vx.upper_threshold), "-equal": _map1(vx.equal),
    "-dil": lambda d, a, _: stencil.dilate(d, int(a)), "-ero": lambda d, a, _: stencil.erode(d, int(a)), "-erot": lambda d, a, _: stencil.erode(d, int(a)), "-smo": lambda d, a, _: stencil.gaussian(d, float(a)), "-sharp": lambda d, a, _: stencil.sharpen(d, float(a)),
    "-zr": lambda d, a, _: stats.robust_z_scored(d, min(1.0, max(0.0, float(a) / 100))), "-pad": lambda d, a, _: reshape.pad(d, int(a), *_shape(d)), "-crop": lambda d, a, _: reshape.crop(d, int(a), *_shape(d)), "-merge": _merge, "-geo": _geodesic,
    "-lltsnorm": lambda d, a, images: stats.trimmed_line_normalized(d, images[a]), "-smol": lambda d, a, _: stencil.label_smooth(d, float(a)), "-edge": lambda d, a, _: stencil.edge(d, float(a)), "-sobel3": lambda d, a, _: stencil.sobel(stencil.gaussian(d, float(a)) if float(a) else d, 3), "-sobel5": lambda d, a, _: stencil.sobel(stencil.gaussian(d, float(a)) if float(a) else d, 5),
    "-tp": lambda d, a, _: d.where(F.col("t") == int(a)), "-odt": lambda d, a, _: d.withColumn("v", vx.output_type(F.col("v"), a)), "-masknan": lambda d, a, images: d.join(images[a].select("i", F.col("v").alias("_m")), "i").withColumn("v", vx.mask_nan(F.col("v"), F.col("_m"))).drop("_m"),
    "-llsnorm": lambda d, a, images: stats.line_normalized(d, images[a]), "-splitinter": lambda d, a, _: reshape.split_interleaved(d, a), "-joininter": lambda d, a, _: reshape.join_interleaved(d, a), "-splitnorm": lambda d, a, _: stencil.split_norm(d, a),
}
TWO: dict[str, Callable] = {
    "-replace": lambda d, a, b, _: d.withColumn("v", vx.replace(F.col("v"), float(a), float(b))), "-lncc": lambda d, a, b, images: stencil.local_ncc(d, images[a], float(b)).withColumnRenamed("lncc", "v"), "-lssd": lambda d, a, b, images: stencil.local_ssd(d, images[a], float(b)),
    "-qlsnorm": lambda d, a, b, images: stats.polynomial_normalized(d, images[b], int(a)), "-qlshnorm": lambda d, a, b, images: stats.quantile_matched(d, images[b], order=int(a)),
    "-smoNaN": lambda d, a, b, images: stencil.fill_missing(d, images[a], float(b)),
}
#: With a mask as the last of three arguments.
THREE: dict[str, Callable] = {
    "-qlsnorm_mask": lambda d, a, b, c, images: stats.masked_normalized(d, images[b], images[c], lambda x, y: stats.polynomial_fit(x, y, int(a))),
    "-qlshnorm_mask": lambda d, a, b, c, images: stats.masked_normalized(d, images[b], images[c], lambda x, y: stats.quantile_fit(x, y, order=int(a))),
}


def compile_chain(steps: list[str], images: dict[str, Image] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The plan of the steps; images are what a step may name in place of a number."""
    images, plan, i = images or {}, [], 0
    while i < len(steps):
        name = steps[i]
        count = next((k for k, known in enumerate((PLAIN, ONE, TWO, THREE)) if name in known), None)
        if count is None:
            raise ValueError(f"unknown step {name}")
        if i + count >= len(steps) + (count == 0):
            raise ValueError(f"{name} takes {count} arguments")
        args = steps[i + 1 : i + 1 + count]
        plan.append((name, args))
        i += 1 + count

    def run(d: DataFrame) -> DataFrame:
        for name, args in plan:
            d = PLAIN[name](d) if not args else (ONE, TWO, THREE)[len(args) - 1][name](d, *args, images)
        return d

    return run
