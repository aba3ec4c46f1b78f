"""Exact Euclidean distances to the nearest set voxel: three passes, one an axis, each over the lines of that axis.

A pass replaces a line's squared distances g by min over q of g(q) + h^2 (x - q)^2, the lower envelope of parabolas, which is
found in one sweep along the line; all lines of an Arrow batch sweep together. Work is in proportion to the voxels whatever the
distances, a pass is one shuffle, and a task holds a batch of lines, never a volume.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Squared distance of where nothing is set.
FAR = 1e300


def envelope(g: np.ndarray, place: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """For lines g (lines, n) at ascending places (lines, n; NaN past a line's end): the least g(q) + h^2 (x - q)^2 at each place
    x, and the q (its number in the line) that gives it; the first of equal ones."""
    lines, n = g.shape
    valid = ~np.isnan(place) & (g < FAR)
    rows = np.arange(lines)
    hull, bounds = np.zeros((lines, n), np.int64), np.full((lines, n + 1), np.inf)
    size = np.zeros(lines, np.int64)
    scaled = np.where(np.isnan(place), 0.0, place) * h
    for q in range(n):
        todo = rows[valid[:, q]]
        cross = np.full(lines, -np.inf)
        while len(todo):
            some = todo[size[todo] > 0]
            top = hull[some, size[some] - 1]
            x, y = scaled[some, q], scaled[some, top]
            cross[some] = (g[some, q] + x * x - g[some, top] - y * y) / (2 * (x - y))
            todo = some[cross[some] <= bounds[some, size[some] - 1]]
            size[todo] -= 1
            cross[todo] = -np.inf
        new = rows[valid[:, q]]
        hull[new, size[new]], bounds[new, size[new]] = q, cross[new]
        size[new] += 1
        bounds[new, size[new]] = np.inf
    out, seed = np.full((lines, n), FAR), np.zeros((lines, n), np.int64)
    at = np.zeros(lines, np.int64)
    for q in range(n):
        here = rows[~np.isnan(place[:, q]) & (size > 0)]
        while True:
            move = here[(at[here] + 1 < size[here]) & (bounds[here, np.minimum(at[here] + 1, n)] < scaled[here, q])]
            if not len(move):
                break
            at[move] += 1
        seed[here, q] = hull[here, at[here]]
        out[here, q] = g[here, seed[here, q]] + (scaled[here, q] - scaled[here, seed[here, q]]) ** 2
    return out, seed


def _along(voxels: DataFrame, axis: str, h: float) -> DataFrame:
    others = [a for a in "xyz" if a != axis]
    lines = voxels.groupBy("t", *others).agg(F.sort_array(F.collect_list(F.struct(F.col(axis).alias("p"), "i", "g", "s"))).alias("_l"))
    lines = lines.select("t", *others, *[F.col(f"_l.{c}").alias(c) for c in "pigs"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in "pigs"}
            at = columns["p"].offsets.to_numpy()
            size = np.diff(at)
            n, inside = int(size.max()), np.arange(size.max())[None] < size[:, None]
            flat = {c: a.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False) for c, a in columns.items()}
            g, place, s = np.full(inside.shape, FAR), np.full(inside.shape, np.nan), np.zeros(inside.shape, np.int64)
            g[inside], place[inside], s[inside] = flat["g"], flat["p"], flat["s"]
            found, seed = envelope(g, place, h)
            s = s[np.arange(len(size))[:, None], seed]
            owner = np.repeat(np.arange(len(size)), size)
            keys = [batch.column(k).take(pa.array(owner)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(flat["p"].astype(np.int32)), pa.array(flat["i"].astype(np.int64)), pa.array(found[inside]), pa.array(s[inside])], ["t", *others, axis, "i", "g", "s"])

    t = dict(voxels.dtypes)["t"]
    return lines.mapInArrow(run, f"t {t}, {others[0]} int, {others[1]} int, {axis} int, i bigint, g double, s bigint")


def exact_distance(voxels: DataFrame, size: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """voxels (t, x, y, z, i, v): (t, x, y, z, i, d, seed): the distance to the nearest voxel above 0, for voxels of this size, and
    its index i; null where a volume has none. Of seeds equally near any may be named; a null or NaN v is not above 0."""
    above = F.coalesce(~F.isnan("v") & (F.col("v") > 0), F.lit(False))
    out = voxels.select("t", "x", "y", "z", F.col("i").cast("bigint").alias("i"), F.when(above, 0.0).otherwise(FAR).alias("g"), F.col("i").cast("bigint").alias("s"))
    out = out.unionByName(_holes(out))
    for axis, h in zip("xyz", size, strict=True):
        out = _along(out, axis, h)
    there = F.col("g") < FAR
    return out.where("i >= 0").select("t", "x", "y", "z", "i", F.when(there, F.sqrt("g")).alias("d"), F.when(there, F.col("s")).alias("seed"))


def _holes(rows: DataFrame) -> DataFrame:
    """Rows with i = -1 where a volume's box has no voxel: distances pass through them too."""
    ends = [f(a).alias(f"_{n}{a}") for a in "xyz" for n, f in (("l", F.min), ("h", F.max))]
    span = lambda a: F.col(f"_h{a}") - F.col(f"_l{a}") + 1
    boxes = rows.groupBy("t").agg(F.count("*").alias("_n"), *ends).where(F.col("_n") < span("x").cast("bigint") * span("y") * span("z"))
    for a in "xyz":
        boxes = boxes.withColumn(a, F.explode(F.sequence(f"_l{a}", f"_h{a}")))
    far = [F.lit(-1).cast("bigint").alias("i"), F.lit(FAR).alias("g"), F.lit(-1).cast("bigint").alias("s")]
    return boxes.select("t", "x", "y", "z", *far).join(rows.select("t", "x", "y", "z"), ["t", "x", "y", "z"], "left_anti")
