"""Simple points by definition, and thinning that changes neither components, holes nor cavities."""

from itertools import product

import numpy as np

from gridloom.operators import topology


def parts(mask, neighbours):
    """Number of connected parts of a mask."""
    left, count = set(map(tuple, np.argwhere(mask))), 0
    steps = [d for d in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, d)) <= neighbours]
    while left:
        todo = [left.pop()]
        count += 1
        while todo:
            p = todo.pop()
            for d in steps:
                q = tuple(a + b for a, b in zip(p, d, strict=True))
                if q in left:
                    left.remove(q)
                    todo.append(q)
    return count


def euler(mask):
    """Vertices - edges + faces - cubes."""
    cells = set()
    for p in np.argwhere(mask):
        for d in product((-1, 0, 1), repeat=3):
            cells.add(tuple(2 * a + b for a, b in zip(p.tolist(), d, strict=True)))
    return sum(1 if sum(c % 2 for c in cell) % 2 == 1 else -1 for cell in cells)


def invariants(mask):
    padded = np.pad(mask, 1)
    return parts(padded, 3), parts(~padded, 1), euler(mask)


def test_simple_points_are_those_whose_removal_changes_nothing():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.4, 0.6, 0.8):
        for _ in range(120):
            mask = rng.random((3, 3, 3)) < share
            mask[1, 1, 1] = True
            without = mask.copy()
            without[1, 1, 1] = False
            code = topology.codes(np.pad(mask, 1), tuple(np.array([1]) for _ in range(3)))
            assert topology.simple(code)[0] == (invariants(mask) == invariants(without))


def volumes():
    rng = np.random.default_rng(4)
    at = np.indices((20, 24, 18))
    ring = (np.hypot(np.hypot(at[1] - 12, at[2] - 9) - 6, at[0] - 10) < 2.5)
    shell = (np.sqrt(((at - np.array([10, 12, 9]).reshape(3, 1, 1, 1)) ** 2).sum(0)) < 7) & (np.sqrt(((at - np.array([10, 12, 9]).reshape(3, 1, 1, 1)) ** 2).sum(0)) > 3)
    return {1: ring, 2: shell, 3: rng.random((20, 24, 18)) < 0.35, 4: np.zeros((20, 24, 18), bool)}


def run(spark, function, found):
    rows = [(t, *map(int, p)) for t, m in found.items() for p in np.argwhere(m)]
    table = spark.createDataFrame(rows, "t long, z int, y int, x int")
    out = {t: np.zeros((20, 24, 18), bool) for t in found}
    for r in function(topology.masks(table, (18, 24, 20), 8)).select("t", "z0", "y0", "x0", "dz", "dy", "dx", "m").collect():
        out[r.t][r.z0 : r.z0 + r.dz, r.y0 : r.y0 + r.dy, r.x0 : r.x0 + r.dx] = np.array(r.m).reshape(r.dz, r.dy, r.dx) > 0
    return out


def test_thinning_and_erosion_keep_the_topology(spark):
    found = volumes()
    want = {t: invariants(m) for t, m in found.items()}
    thin = run(spark, lambda p: topology.thinned(p, 8, ends=False), found)
    for t, m in thin.items():
        assert invariants(m) == want[t] and not (m & ~found[t]).any()
        at = np.nonzero(m)
        assert not len(at[0]) or not topology.simple(topology.codes(np.pad(m, 1), at)).any()
    assert thin[1].sum() < 60 and want[1][2] == 0 and want[2][1] == 2
    small = run(spark, lambda p: topology.eroded(p, 1, 8), found)
    whole = run(spark, lambda p: topology.eroded(p, 1, 32), found)
    for t in found:
        assert invariants(small[t]) == want[t] and (small[t] == whole[t]).all()
    lines = run(spark, lambda p: topology.thinned(p, 8), {1: np.indices((20, 24, 18))[0] == -1, 2: (np.indices((20, 24, 18))[1] == 5) & (np.indices((20, 24, 18))[2] == 5)})
    assert lines[2].sum() == 20
    rows = [(t, *map(int, p)) for t, m in found.items() for p in np.argwhere(m)]
    numbers = {r.t: r.euler for r in topology.euler_number(spark.createDataFrame(rows, "t long, z int, y int, x int")).collect()}
    assert numbers == {t: want[t][2] for t in (1, 2, 3)}
