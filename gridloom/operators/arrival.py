"""Travel times from seeds by sweeping bricks: no volume in a task, and rounds by bricks crossed, not voxels.

A brick is padded by one voxel and swept until nothing in it changes: plane after plane along each axis, there and back, a plane at
a time in numpy. Then bricks exchange their borders. A round of exchanges is one shuffle of the bricks; a path takes about as many
rounds as it crosses bricks, and a brick that nothing new reaches costs one look. Times only fall and a voxel's time depends on lesser
ones only, so the result is that of the whole volume whatever the side.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import bricks
from gridloom.operators.bricks import SIDE, Block, exchange
from gridloom.shared import materialize, release, tidy

#: Least speed, and the share of a time by which it must fall to count as changed.
SLOWEST, STEADY = 1e-4, 1e-13


def over_faces(near: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Times through the least of the face neighbours; near holds each axis' lesser one."""
    return near.min(0) + cost


def upwind(near: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The upwind solution of |grad T| = cost: of one axis, or of two or three where it lies above the others' neighbours."""
    a, b, c = np.sort(near, 0)
    out = a + cost
    with np.errstate(invalid="ignore"):
        two = out > b
        out = np.where(two, (a + b + np.sqrt(np.maximum(2 * cost * cost - (a - b) ** 2, 0))) / 2, out)
        total = a + b + c
        three = two & (out > c)
        return np.where(three, (total + np.sqrt(np.maximum(total * total - 3 * (a * a + b * b + c * c - cost * cost), 0))) / 3, out)


RULES = {"faces": over_faces, "upwind": upwind}


def _shifted(time: np.ndarray, axis: int, step: int) -> np.ndarray:
    """Each voxel's neighbour along an axis; nothing comes from outside."""
    out = np.full_like(time, np.inf)
    to, of = [slice(None)] * time.ndim, [slice(None)] * time.ndim
    to[axis], of[axis] = (slice(1, None), slice(None, -1)) if step > 0 else (slice(None, -1), slice(1, None))
    out[tuple(to)] = time[tuple(of)]
    return out


def swept(time: np.ndarray, cost: np.ndarray, core: np.ndarray, rule) -> np.ndarray:
    """time with the voxels of the core settled, the others fixed."""
    time = time.copy()
    lesser = lambda x, axis: np.minimum(_shifted(x, axis, 1), _shifted(x, axis, -1))
    while True:
        whole = rule(np.stack([lesser(time, k) for k in range(3)]), cost)
        if not (core & (whole < time * (1 - STEADY))).any():
            return time
        for axis in range(3):
            n = time.shape[axis]
            t, c, inside = (np.moveaxis(x, axis, 0) for x in (time, cost, core))
            outside = np.full(t.shape[1:], np.inf)
            for k in (*range(n), *range(n - 1, -1, -1)):
                along = np.minimum(t[k - 1] if k else outside, t[k + 1] if k + 1 < n else outside)
                new = rule(np.stack([along, lesser(t[k], 0), lesser(t[k], 1)]), c[k])
                t[k] = np.where(inside[k] & (new < t[k] * (1 - STEADY)), new, t[k])


def _settle(rule, block: Block):
    """The brick settled; kind 1 where its times changed."""
    before, cost = block.fields["time"][0], block.fields["cost"][0]
    core = np.zeros(before.shape, bool)
    core[block.core] = cost[block.core] > 0
    after = swept(np.where(cost > 0, before, np.inf), np.where(cost > 0, cost, np.inf), core, rule)
    yield block.cut({"time": np.where(cost > 0, after, before)[None], "cost": cost[None]}, kind=int((after < np.where(cost > 0, before, np.inf)).any()))


def _started(block: Block):
    seed, cost = block.fields["seed"], block.fields["cost"]
    yield block.cut({"time": np.where((seed > 0) & (cost > 0), 0.0, np.inf), "cost": cost}, kind=1)


@tidy
def travel_time(voxels: DataFrame, shape: tuple[int, int, int], rule: str = "upwind", side: int = SIDE) -> DataFrame:
    """voxels (t, x, y, z, v, speed) of volumes of this shape (nx, ny, nz): (t, i, x, y, z, time) from the nearest voxel with v > 0
    at the voxels' own speed, at least SLOWEST; rule: upwind (the eikonal equation) or faces (paths over faces, each voxel
    entered at its own cost). Null where no seed reaches. Absent voxels, and those of null or NaN speed, let nothing through and
    have no row; a null or NaN v is no seed."""
    # a seed is 1, since a brick's fields take no infinite or missing values
    speed = F.when(F.col("speed").isNotNull() & ~F.isnan("speed"), F.greatest(F.col("speed").cast("double"), F.lit(SLOWEST)))
    rows = voxels.select("t", "x", "y", "z", (F.coalesce(~F.isnan("v") & (F.col("v") > 0), F.lit(False))).cast("double").alias("seed"), (1 / speed).alias("cost")).where("cost is not null")
    fields = {"time": 1, "cost": 1}
    made = bricks.bricks(rows, {"seed": ["seed"], "cost": ["cost"]}, shape, side)
    now = materialize(exchange(made, {"seed": 1, "cost": 1}, list(fields), _started, side=side))
    while not now.where("kind = 1").isEmpty():
        after = materialize(exchange(now, fields, list(fields), partial(_settle, RULES[rule]), halo=1, side=side))
        release(now)
        now = after
    out = bricks.voxels(now, {"time": ["time"], "cost": ["cost"]}).where("cost > 0")
    return out.select("t", "i", "x", "y", "z", F.when(F.col("time") < float("inf"), F.col("time")).alias("time"))
