import heapq
import itertools

import numpy as np
import pytest

from gridloom.operators import kernels
from gridloom.operators.arrival import travel_time

SCHEMA = "t int, x int, y int, z int, v double, speed double"
SHAPE = (9, 8, 7)


def table(spark, volumes, gone=()):
    rows = [(t, x, y, z, float(v[z, y, x]), float(s[z, y, x])) for t, (v, s) in volumes.items() for z, y, x in np.ndindex(v.shape) if (x, y, z) not in gone]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def times(df, t, shape=SHAPE):
    out = np.full(shape[::-1], np.inf)
    for r in df.where(f"t = {t}").collect():
        out[r.z, r.y, r.x] = np.inf if r.time is None else r.time
        assert r.i == r.x + shape[0] * (r.y + shape[1] * r.z)
    return out


def shortest(v, speed, gone=()):
    """Dijkstra's over faces."""
    time, heap = np.where(v > 0, 0.0, np.inf), [(0.0, tuple(map(int, p))) for p in np.argwhere(v > 0)]
    while heap:
        now, p = heapq.heappop(heap)
        for axis, step in itertools.product(range(3), (-1, 1)):
            q = tuple(c + step * (k == axis) for k, c in enumerate(p))
            if now <= time[p] and all(0 <= c < n for c, n in zip(q, v.shape, strict=True)) and q[::-1] not in gone and now + 1 / speed[q] < time[q]:
                time[q] = now + 1 / speed[q]
                heapq.heappush(heap, (time[q], q))
    return time


@pytest.fixture(scope="module")
def volumes():
    rng = np.random.default_rng(1)
    out = {}
    for t in range(2):
        v = np.zeros(SHAPE[::-1])
        v[tuple(rng.integers(0, v.shape, (2 - t, 3)).T)] = 1
        out[t] = (v, rng.choice([0.05, 1.0, 2.0], v.shape, p=[0.4, 0.3, 0.3]))
    return out


def test_upwind_equals_marching_whatever_the_side(spark, volumes):
    for side in (3, 32):
        found = travel_time(table(spark, volumes), SHAPE, "upwind", side).cache()
        for t, (v, speed) in volumes.items():
            assert np.allclose(times(found, t), kernels.fast_marching(speed)(v), rtol=1e-9)


def test_faces_equal_shortest_paths_around_walls(spark, volumes):
    gone = {(4, y, z) for y in range(8) for z in range(7) if (y, z) != (7, 6)}  # one gate
    found = travel_time(table(spark, volumes, gone), SHAPE, "faces", 4).cache()
    for t, (v, speed) in volumes.items():
        seeds = v.copy()
        for x, y, z in gone:
            seeds[z, y, x] = 0
        want = shortest(seeds, speed, gone)
        for x, y, z in gone:
            want[z, y, x] = np.inf
        assert np.allclose(times(found, t), want)


def test_nulls_no_seeds_and_empty_tables(spark):
    assert travel_time(spark.createDataFrame([], SCHEMA), (3, 1, 1)).count() == 0
    rows = [(0, 0, 0, 0, 1.0, 1.0), (0, 1, 0, 0, None, 0.5), (0, 2, 0, 0, float("nan"), None), (1, 0, 0, 0, 0.0, 1.0), (1, 1, 0, 0, 0.0, 1.0)]
    got = {(r.t, r.x): r.time for r in travel_time(spark.createDataFrame(rows, SCHEMA), (3, 1, 1)).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 2.0, (1, 0): None, (1, 1): None}
