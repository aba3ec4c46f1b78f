"""SQL for queries whose text is longer than a line: neighbourhoods, histograms and resampling on 4 x 4 x 4 volumes.

Each text goes after the common table vox (t, label, i, x, y, z, v).
"""

from __future__ import annotations

LINE = {"x": "y, z", "y": "x, z", "z": "x, y"}


def frames(start: str, steps: list[str]) -> tuple[str, str]:
    """Tables of window aggregates, one an axis and step, each over the one before; and the last one's name."""
    parts, name = [], start
    for k, step in enumerate(steps):
        for axis, others in LINE.items():
            over = f"(PARTITION BY t, {others} ORDER BY {axis} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
            parts.append(f"f{k}{axis} AS (SELECT t, i, x, y, z, {step}(v) OVER {over} AS v FROM {name})")
            name = f"f{k}{axis}"
    return ", ".join(parts), name


def near(axis: str, step: int) -> str:
    call = "lag" if step < 0 else "lead"
    return f"{call}(v) OVER (PARTITION BY t, {LINE[axis]} ORDER BY {axis})"


NEIGHBOURS = [near(a, s) for a in "xyz" for s in (-1, 1)]


def box(first: str, second: str) -> str:
    parts, name = frames("vox", [first, second])
    return f"WITH {parts} SELECT t, i, v FROM {name}"


def blurred(sigma: float, out: str) -> str:
    """Gaussian sums along each axis, divided by the weights that meet a voxel; 4 voxels are within 3 sigma."""
    parts, name = [], "vox"
    for axis, others in LINE.items():
        same = " AND ".join(f"a.{c} = b.{c}" for c in ["t", *others.split(", ")])
        w = f"exp(-0.5::DOUBLE * pow((a.{axis} - b.{axis}) / {sigma!r}::DOUBLE, 2))"
        parts.append(f"g{axis} AS (SELECT a.t, a.i, a.x, a.y, a.z, sum(b.v * {w}) / sum({w}) AS v FROM {name} a JOIN {name} b ON {same} GROUP BY ALL)")
        name = f"g{axis}"
    return f"WITH {', '.join(parts)} SELECT g.t, g.i, round({out}, 6) + 0 AS v FROM {name} g JOIN vox ON g.t = vox.t AND g.i = vox.i"


def sobel(smooth: dict[int, int], differ: dict[int, int]) -> str:
    parts, name, kept = [], "vox", {"sx": "v", "sy": "v", "sz": "v"}
    case = lambda d, w: "CASE " + " ".join(f"WHEN {d} = {k} THEN {x}" for k, x in w.items()) + " ELSE 0 END"
    for axis, others in LINE.items():
        same = " AND ".join(f"a.{c} = b.{c}" for c in ["t", *others.split(", ")])
        sums = ", ".join(f"sum(b.{c} * ({case(f'b.{axis} - a.{axis}', differ if to == 's' + axis else smooth)})) AS {to}" for to, c in kept.items())
        parts.append(f"e{axis} AS (SELECT a.t, a.i, a.x, a.y, a.z, {sums} FROM {name} a JOIN {name} b ON {same} GROUP BY ALL)")
        name, kept = f"e{axis}", {c: c for c in kept}
    return f"WITH {', '.join(parts)} SELECT t, i, round(sqrt(sx * sx + sy * sy + sz * sz), 6) AS v FROM {name}"


def rounds(count: int, value: str) -> str:
    parts, name = [], "vox"
    for k in range(count):
        parts.append(f"r{k} AS (SELECT t, i, x, y, z, {value} AS v FROM {name})")
        name = f"r{k}"
    return f"WITH {', '.join(parts)} SELECT t, i, round(v, 6) + 0 AS v FROM {name}"


def tukey(x: str) -> str:
    return f"coalesce(CASE WHEN abs({x}) < 0.3::DOUBLE THEN ({x}) * pow(1 - pow(({x}) / 0.3::DOUBLE, 2), 2) ELSE 0 END, 0)"


HISTOGRAM = """m AS (SELECT t, min(v) AS low, max(v) AS high FROM vox GROUP BY t),
    h AS (SELECT vox.t, low, high, least({bins} - 1, floor((v - low) / CASE WHEN high > low THEN high - low ELSE 1 END * {bins}))::INT AS bin, count(*) AS n
          FROM vox JOIN m ON vox.t = m.t GROUP BY ALL)"""

#: Where the turned lattice meets the volumes.
TURNED = "p AS MATERIALIZED (SELECT t, i, 0.9::DOUBLE * x + 0.1::DOUBLE * y + 0.2::DOUBLE AS px, -0.1::DOUBLE * x + 0.9::DOUBLE * y + 0.3::DOUBLE AS py, z + 0.5::DOUBLE AS pz FROM vox)"
INSIDE = "CASE WHEN cx BETWEEN 0 AND 3 AND cy BETWEEN 0 AND 3 AND cz BETWEEN 0 AND 3 THEN t * 64 + cx + 4 * cy + 16 * cz END"
PLACES = "s AS MATERIALIZED (SELECT t * 64 + i AS k, v FROM vox)"

SECOND = {a: f"pow(lag(u) OVER (PARTITION BY t, kind, {o} ORDER BY {a}) - 2 * u + lead(u) OVER (PARTITION BY t, kind, {o} ORDER BY {a}), 2)" for a, o in LINE.items()}

TEXTS = {
    "close_box": box("max", "min"),
    "open_box": box("min", "max"),
    "gauss_separable": blurred(1.0, "g.v"),
    "fwhm_smooth": blurred(3.0 / 2.3548200450309493, "g.v"),
    "vox_sharpen": blurred(1.0, "vox.v - g.v"),
    "sobel3": sobel({-1: 1, 0: 2, 1: 1}, {-1: -1, 1: 1}),
    "sobel5": sobel({-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}, {-2: -1, -1: -2, 1: 2, 2: 1}),
    "laplace": rounds(3, f"CASE WHEN i % 3 > 0 THEN ({' + '.join(f'coalesce({n}, 0)' for n in NEIGHBOURS)}) / ({' + '.join(f'({n} IS NOT NULL)::INT' for n in NEIGHBOURS)}) ELSE v END"),
    "diffuse": rounds(2, f"v + ({' + '.join(tukey(f'{n} - v') for n in NEIGHBOURS)}) / 7"),
    "edge": "SELECT t, i, CASE WHEN " + " OR ".join(f"coalesce(greatest(v, {n}) <> 0 AND {n} IS NOT NULL AND abs(v - {n}) / greatest(v, {n}) > 0.5::DOUBLE, false)" for n in NEIGHBOURS) + " THEN v ELSE 0 END + 0 AS v FROM vox",
    "split_norm": f"""WITH a AS (SELECT t, i, z, v, CASE WHEN z % 2 = 0 AND v <> 0 THEN {near("z", 1)} / v END AS r FROM vox),
    m AS (SELECT t, quantile_cont(r, 0.5) AS m FROM a WHERE r IS NOT NULL GROUP BY t)
    SELECT a.t, i, round(CASE WHEN z % 2 = 0 THEN v * coalesce(m, 1) ELSE v END, 6) + 0 AS v FROM a LEFT JOIN m ON a.t = m.t""",
    "vox_mixed_gaussian": """WITH s AS (SELECT -0.1::DOUBLE * a + 0.1::DOUBLE * (1 - a) AS m, 0.01::DOUBLE * a * a + 0.02::DOUBLE * (1 - a) * (1 - a) AS q FROM (SELECT (k + 0.5::DOUBLE) / 100 AS a FROM generate_series(0, 99) g(k)))
    SELECT t, i, round(sum(exp(-(v - m) * (v - m) / (2 * q)) / sqrt(2 * pi() * q)) / 100, 6) AS v FROM vox, s GROUP BY t, i""",
    "bending_energy": f"""WITH u AS (SELECT t, x, y, z, 1 AS kind, v AS u FROM vox UNION ALL SELECT t, x, y, z, 2, v * v FROM vox),
    e AS (SELECT t, {" + ".join(f"coalesce({s}, 0)" for s in SECOND.values())} AS e FROM u)
    SELECT t, round(sum(e) / 64, 6) AS bending_energy FROM e GROUP BY t""",
    "jacobian": "SELECT t, i, round((0.9::DOUBLE * 0.9::DOUBLE + 0.1::DOUBLE * 0.1::DOUBLE) * 1, 6) AS jacobian FROM vox",
    "resample_nearest": f"""WITH {TURNED}, {PLACES}, c AS (SELECT t, i, floor(px + 0.5::DOUBLE)::INT AS cx, floor(py + 0.5::DOUBLE)::INT AS cy, floor(pz + 0.5::DOUBLE)::INT AS cz FROM p)
    SELECT t, i, coalesce(v, 0) AS v FROM (SELECT t, i, {INSIDE} AS k FROM c) d LEFT JOIN s ON d.k = s.k""",
    "resample_linear": f"""WITH {TURNED}, {PLACES},
    c AS (SELECT t, i, (floor(px) + a)::INT AS cx, (floor(py) + b)::INT AS cy, (floor(pz) + e)::INT AS cz,
                 abs(1 - a - (px - floor(px))) * abs(1 - b - (py - floor(py))) * abs(1 - e - (pz - floor(pz))) AS w
          FROM p, generate_series(0, 1) f(a), generate_series(0, 1) g(b), generate_series(0, 1) h(e))
    SELECT t, i, round(sum(w * coalesce(v, 0)), 6) + 0 AS v FROM (SELECT t, i, w, {INSIDE} AS k FROM c) d LEFT JOIN s ON d.k = s.k GROUP BY t, i""",
    "vox_robust_z": """WITH k AS MATERIALIZED (SELECT t, v, row_number() OVER (PARTITION BY t ORDER BY v) - 1 AS k FROM vox),
    o AS MATERIALIZED (SELECT t, max(CASE WHEN k = round(0.1::DOUBLE * 63) THEN v END) AS low, max(CASE WHEN k = round(0.9::DOUBLE * 63) THEN v END) AS high FROM k GROUP BY t),
    m AS MATERIALIZED (SELECT k.t, avg(v) AS m, stddev_pop(v) AS s FROM k JOIN o ON k.t = o.t WHERE v > low AND v < high GROUP BY k.t)
    SELECT vox.t, i, round((v - m) / s, 6) + 0 AS v FROM vox JOIN m ON vox.t = m.t""",
    "otsu": f"""WITH {HISTOGRAM.format(bins=32)},
    c AS (SELECT t, bin, (sum(n) OVER w)::DOUBLE AS w, (sum(n * bin) OVER w)::DOUBLE AS s, (sum(n) OVER a)::DOUBLE AS n_all, (sum(n * bin) OVER a)::DOUBLE AS s_all
          FROM h WINDOW w AS (PARTITION BY t ORDER BY bin), a AS (PARTITION BY t)),
    b AS (SELECT t, bin, w * (n_all - w) * pow(s / w - (s_all - s) / (n_all - w), 2) AS between FROM c WHERE n_all > w)
    SELECT t, bin, round(between, 6) AS between FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY between DESC, bin) AS k FROM b) WHERE k = 1""",
    "stat_histogram_percentile": f"""WITH {HISTOGRAM.format(bins=1000)}, c AS (SELECT *, sum(n) OVER (PARTITION BY t ORDER BY bin) AS c FROM h)
    SELECT t, round(min(low) + min(bin) * (min(high) - min(low)) / 1000, 6) AS percentile FROM c WHERE c >= 64 * 0.9::DOUBLE GROUP BY t""",
    "joint_entropies": """WITH b AS MATERIALIZED (SELECT t, i, floor(v * 16 + 8)::INT AS p FROM vox), f AS MATERIALIZED (SELECT i, p AS q FROM b WHERE t = 0),
    j AS MATERIALIZED (SELECT t, p, q FROM b JOIN f ON b.i = f.i WHERE p BETWEEN 0 AND 15 AND q BETWEEN 0 AND 15),
    n AS (SELECT t, count(*)::DOUBLE AS n FROM j GROUP BY t),
    c AS (SELECT t, 'p' AS kind, count(*) AS c FROM j GROUP BY t, p UNION ALL SELECT t, 'q', count(*) FROM j GROUP BY t, q UNION ALL SELECT t, 'j', count(*) FROM j GROUP BY t, p, q),
    h AS (SELECT c.t, -sum(CASE WHEN kind = 'p' THEN c / n * ln(c / n) ELSE 0 END) AS a, -sum(CASE WHEN kind = 'q' THEN c / n * ln(c / n) ELSE 0 END) AS b,
                 -sum(CASE WHEN kind = 'j' THEN c / n * ln(c / n) ELSE 0 END) AS j FROM c JOIN n ON c.t = n.t GROUP BY c.t)
    SELECT t, round(a, 6) + 0 AS h_a, round(b, 6) + 0 AS h_b, round(j, 6) + 0 AS h_joint, round((a + b) / j, 6) AS nmi FROM h""",
}
