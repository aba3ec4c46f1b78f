"""Operators whose order of work is the point of them: one volume a group, in numpy, volumes in parallel.

A group is one volume (the unit that the tools work on), so its size is bound by the format, not by the data. Kernels that work on
stacks of volumes get several small ones at once (per_stack), STACK voxels or one volume.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "t long, i int, v double"
STACK = 1 << 15


def per_volume(voxels: DataFrame, shape: tuple[int, int, int], kernel) -> DataFrame:
    """kernel(array[z, y, x]) of every volume; voxels that are not there are NaN."""
    nx, ny, nz = shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        box = np.full(nx * ny * nz, np.nan)
        box[pdf.i] = pdf.v
        out = kernel(box.reshape(nz, ny, nx))
        return pd.DataFrame({"t": pdf.t.iloc[0], "i": np.arange(nx * ny * nz, dtype=np.int32), "v": out.ravel().astype(float)})

    return voxels.select("t", "i", "v").groupBy("t").applyInPandas(run, SCHEMA)


def per_stack(voxels: DataFrame, shape: tuple[int, int, int], kernel) -> DataFrame:
    """kernel(array[t, z, y, x]) of volumes whose t differ in the last bits only; as per_volume() otherwise."""
    nx, ny, nz = shape
    each = nx * ny * nz
    bits = max(0, (STACK // each).bit_length() - 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, at = np.unique(pdf.t, return_inverse=True)
        box = np.full((len(t), each), np.nan)
        box[at, pdf.i] = pdf.v
        out = kernel(box.reshape(-1, nz, ny, nx))
        return pd.DataFrame({"t": np.repeat(t, each), "i": np.tile(np.arange(each, dtype=np.int32), len(t)), "v": out.ravel().astype(float)})

    return voxels.select("t", "i", "v", F.shiftright(F.col("t").cast("bigint"), bits).alias("_group")).groupBy("_group").applyInPandas(run, SCHEMA)


def _box_sum(a: np.ndarray, reach: int) -> np.ndarray:
    """Sum over a cube of the given reach, edges repeated, along the last three axes."""
    for axis in (-3, -2, -1):
        m = np.moveaxis(a, axis, 0)
        e = np.concatenate([m[:1]] * reach + [m] + [m[-1:]] * reach)
        a = np.moveaxis(sum(e[k : k + len(m)] for k in range(2 * reach + 1)), 0, axis)
    return a


def non_local_means(h: float, search: int = 3, patch: int = 1):
    """Mean over a search box, weighted by the likeness of patches; the centre weighs as much as its best match. Takes stacks."""
    reach = range(-search, search + 1)

    def kernel(a: np.ndarray) -> np.ndarray:
        total, weight, best = np.zeros_like(a), np.zeros_like(a), np.zeros_like(a)
        wide = np.pad(a, [(0, 0)] * (a.ndim - 3) + [(search, search)] * 3, mode="edge")
        for dz in reach:
            for dy in reach:
                for dx in reach:
                    if dz or dy or dx:
                        other = wide[(..., *(slice(search + d, search + d + n) for d, n in zip((dz, dy, dx), a.shape[-3:], strict=True)))]
                        near = _box_sum((a - other) ** 2, patch) / (2 * patch + 1) ** 3
                        w = np.exp(-near / (h * h))
                        total += w * other
                        weight += w
                        best = np.maximum(best, w)
        best = np.where(best > 0, best, 1)
        return (total + best * a) / (weight + best)

    return kernel


_FACES = ((0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0))


def watershed(markers: np.ndarray):
    """Flooding from markers in order of height; each voxel takes the label that reaches it first."""

    def kernel(a: np.ndarray) -> np.ndarray:
        label = markers.copy()
        heap = [(a[tuple(p)], k, tuple(p)) for k, p in enumerate(np.argwhere(label > 0))]
        heapq.heapify(heap)
        turn = len(heap)
        while heap:
            height, _, p = heapq.heappop(heap)
            for d in _FACES:
                q = tuple(x + y for x, y in zip(p, d, strict=True))
                if all(0 <= x < n for x, n in zip(q, a.shape, strict=True)) and not label[q]:
                    label[q] = label[p]
                    heapq.heappush(heap, (max(height, a[q]), turn, q))
                    turn += 1
        return label

    return kernel


def fast_marching(speed: np.ndarray):
    """Arrival time from voxels above 0: the upwind solution of |grad T| = 1 / speed."""

    def kernel(a: np.ndarray) -> np.ndarray:
        time = np.where(a > 0, 0.0, np.inf)
        done = np.zeros(a.shape, bool)
        heap = [(0.0, tuple(p)) for p in np.argwhere(a > 0)]
        heapq.heapify(heap)
        while heap:
            _, p = heapq.heappop(heap)
            if done[p]:
                continue
            done[p] = True
            for d in _FACES:
                q = tuple(x + y for x, y in zip(p, d, strict=True))
                if not all(0 <= x < n for x, n in zip(q, a.shape, strict=True)) or done[q]:
                    continue
                least = []
                for axis in range(3):
                    both = [time[q[:axis] + (q[axis] + s,) + q[axis + 1 :]] for s in (1, -1) if 0 <= q[axis] + s < a.shape[axis]]
                    least.append(min(both, default=np.inf))
                cost, known = 1 / max(1e-4, speed[q]), sorted(x for x in least if x < np.inf)
                arrival = known[0] + cost
                for n in range(2, len(known) + 1):
                    s, ss = sum(known[:n]), sum(x * x for x in known[:n])
                    root = s * s - n * (ss - cost * cost)
                    if arrival > known[n - 1] and root >= 0:
                        arrival = (s + root**0.5) / n
                if arrival < time[q]:
                    time[q] = arrival
                    heapq.heappush(heap, (arrival, q))
        return time

    return kernel


def patch_fill(mask: np.ndarray, search: int = 3, patch: int = 1):
    """Masked voxels filled, outermost first, with the value whose surroundings fit best inside the search box. Takes stacks.

    Which places are compared depends on the mask alone, so they are found once for all volumes of a stack.
    """

    def offsets(reach: int) -> np.ndarray:
        return np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * 3, indexing="ij"), -1).reshape(-1, 3)

    def kernel(a: np.ndarray) -> np.ndarray:
        shape, out = mask.shape, a.reshape(-1, mask.size).copy()
        open_ = mask.ravel().copy()

        def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which of the places are voxels that are not open, and their indices."""
            inside = ((at >= 0) & (at < shape)).all(-1)
            index = np.where(inside, at @ np.array([shape[1] * shape[2], shape[2], 1]), 0)
            return inside & ~open_[index], index

        while open_.any():
            left = np.argwhere(open_.reshape(shape))
            ring = left[places(left[:, None] + np.array(_FACES))[0].any(1)]
            if not len(ring):
                break
            filled = []
            for p in ring:
                good, centre = places(p + offsets(search))
                spots, centre = (p + offsets(search))[good], centre[good]
                there, mine = places(p + offsets(patch))
                gap, n = np.zeros((len(out), len(spots))), np.zeros(len(spots), int)
                for d, here, e in zip(offsets(patch), there, mine, strict=True):
                    if here:
                        both, f = places(spots + d)
                        gap[:, both] += (out[:, e, None] - out[:, f[both]]) ** 2
                        n += both
                best, value = np.full(len(out), np.inf), np.zeros(len(out))
                for k in np.flatnonzero(n):
                    far, v = gap[:, k] / n[k], out[:, centre[k]]
                    nearer = (far < best) | ((far == best) & (v < value))
                    best, value = np.where(nearer, far, best), np.where(nearer, v, value)
                filled.append(value)
            at = places(ring)[1]
            out[:, at] = np.stack(filled, 1)
            open_[at] = False
        return out.reshape(a.shape)

    return kernel


def spline_prefilter(a: np.ndarray) -> np.ndarray:
    """Coefficients whose cubic B-spline passes through the values, mirrored edges."""
    pole = np.sqrt(3) - 2
    for axis in range(3):
        m = np.moveaxis(a, axis, 0) * 6.0
        n = len(m)
        if n > 1:
            k = np.arange(2 * n - 2)
            mirror = np.concatenate([m, m[-2:0:-1]])
            c = np.empty_like(m)
            c[0] = np.tensordot(pole**k, mirror, 1) / (1 - pole ** (2 * n - 2))
            for i in range(1, n):
                c[i] = m[i] + pole * c[i - 1]
            c[-1] = pole / (pole * pole - 1) * (c[-1] + pole * c[-2])
            for i in range(n - 2, -1, -1):
                c[i] = pole * (c[i + 1] - c[i])
            a = np.moveaxis(c, 0, axis)
    return a
