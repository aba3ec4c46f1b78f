"""Exact distances against all pairs."""

import numpy as np
import pytest

from gridloom.operators import distance


def test_envelopes_against_all_parabolas():
    rng = np.random.default_rng(1)
    g = np.where(rng.random((40, 25)) < 0.3, rng.integers(0, 90, (40, 25)).astype(float), distance.FAR)
    place = np.cumsum(rng.integers(1, 4, (40, 25)), 1).astype(float)
    place[5, 20:] = np.nan
    g[7] = distance.FAR
    out, seed = distance.envelope(g, place, 1.5)
    for k in range(40):
        for x in np.flatnonzero(~np.isnan(place[k])):
            all_ = [g[k, q] + 2.25 * (place[k, x] - place[k, q]) ** 2 for q in np.flatnonzero(~np.isnan(place[k]) & (g[k] < distance.FAR))]
            assert out[k, x] == (pytest.approx(min(all_)) if all_ else distance.FAR)
            assert not all_ or g[k, seed[k, x]] + 2.25 * (place[k, x] - place[k, seed[k, x]]) ** 2 == pytest.approx(min(all_))


@pytest.mark.parametrize("size", [(1.0, 1.0, 1.0), (1.0, 2.0, 0.5)])
def test_volumes_against_all_pairs(spark, size):
    rng = np.random.default_rng(2)
    shapes = {1: (7, 5, 9), 2: (12, 3, 4), 3: (2, 2, 2)}
    rows = []
    for t, (nx, ny, nz) in shapes.items():
        v = rng.random((nx, ny, nz)) < (0.06 if t < 3 else 0)
        rows += [(t, x, y, z, x + nx * (y + ny * z), float(v[x, y, z]) if (x + y) % 5 or v[x, y, z] else None) for x, y, z in np.ndindex(nx, ny, nz)]
    rows = [r for r in rows if r[0] != 2 or r[5] or r[1] < 8 or r[2] != 1]  # a volume with holes
    table = spark.createDataFrame(rows, "t int, x int, y int, z int, i int, v double").repartition(3)
    got = {(r.t, r.x, r.y, r.z): r for r in distance.exact_distance(table, size).collect()}
    assert len(got) == len(rows)
    for t in shapes:
        places = {r[4]: np.array(r[1:4]) * size for r in rows if r[0] == t}
        seeds = [r[4] for r in rows if r[0] == t and r[5]]
        for r in rows:
            if r[0] == t:
                found = got[r[:4]]
                if not seeds:
                    assert found.d is None and found.seed is None
                    continue
                want = min(np.linalg.norm(places[r[4]] - places[s]) for s in seeds)
                assert found.d == pytest.approx(want) and found.seed in seeds
                assert np.linalg.norm(places[r[4]] - places[found.seed]) == pytest.approx(want)
    assert distance.exact_distance(table.limit(0)).count() == 0
