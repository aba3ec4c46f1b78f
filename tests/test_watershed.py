import heapq
import itertools

import numpy as np

from gridloom.operators import kernels
from gridloom.operators.watershed import watershed

SCHEMA = "t int, x int, y int, z int, i int, v double, marker int"


def flood(heights: dict, markers: dict) -> dict:
    """Priority flood in order of (v, i): label and level by place."""
    heap = [(heights[p], heights[p], p) for p in markers if p in heights]
    heapq.heapify(heap)
    label, level, done = dict(markers), {}, set()
    while heap:
        high, _, p = heapq.heappop(heap)
        if p in done:
            continue
        done.add(p)
        level[p] = high
        for axis, step in itertools.product(range(3), (-1, 1)):
            q = tuple(c + step * (k == axis) for k, c in enumerate(p))
            if q in heights and q not in label:
                label[q] = label[p]
                heapq.heappush(heap, (max(high, heights[q]), heights[q], q))
    return {p: (label.get(p, 0), level[p][0] if p in level else None) for p in heights}


def rows_of(t, a, markers, gone=()):
    n = a.shape
    places = [p for p in itertools.product(*map(range, n)) if p not in gone]
    return [(t, *p, p[0] + n[0] * (p[1] + n[1] * p[2]), float(a[p]), markers.get(p)) for p in places]


def same(spark, rows):
    got = {(r.t, r.x, r.y, r.z): (r.label, r.level) for r in watershed(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    for t in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == t]
        want = flood({r[1:4]: (r[5], r[4]) for r in mine}, {r[1:4]: r[6] for r in mine if r[6]})
        assert {k[1:]: v for k, v in got.items() if k[0] == t} == want


def test_equals_the_priority_flood(spark):
    rng = np.random.default_rng(1)
    noise, steps = rng.normal(size=(9, 7, 6)), rng.integers(0, 4, size=(6, 6, 6)).astype(float)  # the second is full of ties
    wall = np.ones((5, 5, 5))
    rows = rows_of(0, noise, {(0, 0, 0): 3, (8, 6, 5): 1, (4, 3, 2): 2})
    rows += rows_of(1, steps, {(5, 5, 5): 2, (1, 1, 1): 7, (1, 1, 2): 9})
    rows += rows_of(2, wall, {(2, 2, 2): 4}, gone={(x, y, 3) for x in range(5) for y in range(5)})  # cut off beyond z = 3
    rows += rows_of(3, wall, {})
    same(spark, rows)


def test_equals_the_queue_of_one_volume(spark):
    a = np.random.default_rng(2).permutation(216).reshape(6, 6, 6).astype(float)
    markers = np.zeros(a.shape, int)
    markers[1, 1, 1], markers[4, 4, 4], markers[0, 5, 2] = 1, 2, 3
    want = kernels.watershed(markers)(a)
    rows = rows_of(0, a, {tuple(map(int, p)): int(markers[tuple(p)]) for p in np.argwhere(markers)})
    got = {(r.x, r.y, r.z): r.label for r in watershed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[p] == want[p] for p in got)


def test_null_heights_and_empty_tables(spark):
    assert watershed(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, 0, 0, 0, 0, 1.0, 5), (0, 1, 0, 0, 1, None, None), (0, 2, 0, 0, 2, 0.0, -1), (1, 0, 0, 0, 0, None, 2)]
    got = {(r.t, r.i): (r.label, r.level) for r in watershed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k][0] for k in sorted(got)] == [5, 5, 5, 2] and np.isnan(got[0, 2][1]) and got[0, 0][1] == 1.0
