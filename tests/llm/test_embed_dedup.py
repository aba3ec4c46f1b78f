import numpy as np

from gridloom.llm import embed_dedup
from gridloom.llm.embed_dedup import near_vectors


def brute(rows):
    def sound(e, label):
        return label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)

    n = len(rows)
    unit = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if sound(e, label) else None for _, e, label in rows]
    link = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98 for j in range(n)] for i in range(n)]
    part = list(range(n))
    for _ in range(n):
        before = list(part)
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    part[i] = part[j] = min(part[i], part[j])
        if before == part:
            break
    return {rows[i][0]: (sum(link[i]), min(rows[j][0] for j in range(n) if part[j] == part[i])) for i in range(n)}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 900
    for c in range(12):
        base = rng.normal(size=16)
        for k in range(12):
            base = base + rng.normal(size=16) * (0.12 if c % 2 else 0.25)
            rows.append((i := i - 1, [float(x) for x in base.astype("f4")], c % 3))
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(6)] + [(3000, [2 * x for x in rows[5][1]], rows[5][2])]
    rows += [(4000, None, 1), (4001, [0.0] * 16, 1), (4002, [float("nan")] * 16, 1), (4003, [None] + [1.0] * 15, 1), (4004, [1.0] * 16, None), (4005, [], 1), (4006, [1.0, 2.0], 1), (4007, [1.0, 2.0], 1), (4008, [float("inf")] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = near_vectors(table).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and sum(r.n_links for r in got) > 60


def test_empty_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, node int"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1, 1)] * 2 + [(None, [1.0, 0.0], 1, 1), (None, None, 1, 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_many_tiles_parts_and_chunks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 12)
    monkeypatch.setattr(embed_dedup, "CELL", 3)
    monkeypatch.setattr(embed_dedup, "AT_ONCE", 400)
    rng = np.random.default_rng(2)
    rows = []
    for dim, n in ((8, 150), (5, 60), (1, 40)):
        hubs = rng.normal(size=(n // 8 + 1, dim))
        for _ in range(n):
            v = hubs[int(rng.integers(len(hubs)))] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.4])
            rows.append((len(rows), [float(x) for x in v.astype("f4")], int(rng.integers(2)) if dim > 1 else 0))
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table).collect()} == brute(rows)


def test_traversal_is_nearest_first_and_whole():
    rng = np.random.default_rng(3)
    a, b = rng.random((40, 7)), rng.random((40, 5))
    a[3], b[4] = 0.5, 0.0  # ties
    row, first, second = embed_dedup.traversal(a, b, 0.8)
    want = {(i, j, k) for i in range(40) for j in range(7) for k in range(5) if a[i, j] + b[i, k] <= 0.8}
    got = list(zip(row.tolist(), first.tolist(), second.tolist(), strict=True))
    assert len(got) == len(set(got)) and set(got) == want
    for i in range(40):
        sums = [a[i, j] + b[i, k] for r, j, k in got if r == i]
        assert sums == sorted(sums)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, centres = rng.normal(size=(200, 6)), rng.normal(size=(9, 6))
    own, least = embed_dedup._bounds(x, centres)
    apart = ((x[:, None] - x[None]) ** 2).sum(2)
    assert (least[:, own] <= apart + 1e-9).all()
    assert np.array_equal(embed_dedup._bounds(x[:1], centres)[1], least[:1])


def test_grids_are_built_for_small_labels_and_grow(spark, monkeypatch):
    built, plain = [], embed_dedup.Grid

    def noted(sample, codes):
        built.append((len(sample), codes))
        return plain(sample, codes)

    monkeypatch.setattr(embed_dedup, "Grid", noted)
    rng = np.random.default_rng(5)
    sizes = {"few": 2, "some": 100, "many": 800}
    rows = [(1000 * k + i, [float(v) for v in rng.normal(size=4).astype("f4")], name) for k, (name, n) in enumerate(sizes.items()) for i in range(n)]
    for wanted, (name, n) in zip((2, 4, 10), sizes.items(), strict=True):
        table = spark.createDataFrame([r for r in rows if r[2] == name], "vec_id long, embedding array<float>, label string")
        assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table).collect()} == brute([r for r in rows if r[2] == name]) if n < 800 else near_vectors(table).count() == n
        assert built[-1] == (n, wanted)


def test_labels_keep_their_type(spark):
    near, rows = [1.0, 0.0], []
    for i, label in enumerate((1.0, 1.5, 1.5, 2.0)):
        rows.append((i, near, label))
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label double")).collect()
    assert {r.vec_id: r.n_links for r in got} == {0: 0, 1: 1, 2: 1, 3: 0}


def test_most_cells_are_not_visited():
    rng = np.random.default_rng(6)
    hubs = rng.normal(size=(200, 32))
    x = hubs[rng.integers(200, size=4000)] + rng.normal(size=(4000, 32)) * 0.1
    x /= np.sqrt((x * x).sum(1))[:, None]
    grid = embed_dedup.Grid(x, 23)
    own = grid.own(x)
    row, cell = grid.visits(x, 0.04)
    members = np.bincount(own, minlength=len(grid.rank))
    assert members[cell].sum() < 0.1 * len(x) ** 2
    met = set(zip(row.tolist(), cell.tolist(), strict=True))
    linked = np.argwhere(x @ x.T >= 0.98)
    assert all((i, own[j]) in met for i, j in linked.tolist())
