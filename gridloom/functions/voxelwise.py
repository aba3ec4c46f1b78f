"""Voxelwise functions as columns. Comparisons are false for NaN, division and logarithm follow IEEE, NaN is missing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def above(v: Column, bound) -> Column:
    return ~F.isnan(v) & (v > bound)


def below(v: Column, bound) -> Column:
    return ~F.isnan(v) & (v < bound)


def divide(a: Column, b: Column) -> Column:
    """IEEE quotient: x/0 is an infinity of x's sign, 0/0 is NaN."""
    return F.when(b != 0, F.try_divide(a, b)).when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))


def recip(v: Column) -> Column:
    return divide(F.lit(1.0), v)


def log(v: Column) -> Column:
    return F.when(F.isnan(v) | (v < 0), F.lit(NAN)).when(v == 0, F.lit(-INF)).otherwise(F.ln(v))


def threshold(v: Column, bound: float) -> Column:
    """v where it is above the bound, else 0."""
    return F.when(above(v, bound), v).otherwise(0.0)


def upper_threshold(v: Column, bound: float) -> Column:
    return F.when(below(v, bound), v).otherwise(0.0)


def binarise(v: Column) -> Column:
    return F.when(above(v, 0), 1.0).otherwise(0.0)


def binarise_nonzero(v: Column) -> Column:
    return F.when(v != 0, 1.0).otherwise(0.0)


def signed_mask(v: Column) -> Column:
    """1 inside, -1 outside."""
    return F.when(v != 0, 1).otherwise(-1)


def equal(v: Column, n: float) -> Column:
    return F.when(v == n, 1.0).otherwise(0.0)


def replace(v: Column, old: float, new: float) -> Column:
    return F.when(v == old, F.lit(new)).otherwise(v)


def remove_nan(v: Column) -> Column:
    return F.nanvl(v, F.lit(0.0))


def is_nan(v: Column) -> Column:
    return F.isnan(v).cast("double")


def mask_nan(v: Column, mask: Column) -> Column:
    return F.when(above(mask, 0), v).otherwise(F.lit(NAN))


LIMITS = {"tinyint": (-128, 127), "uint8": (0, 255), "smallint": (-32768, 32767), "uint16": (0, 65535), "int": (-(2**31), 2**31 - 1)}


def output_type(v: Column, kind: str) -> Column:
    """Rounded half away from zero and clamped for whole-number types; others are cast."""
    if kind not in LIMITS:
        return v.cast(kind)
    low, high = LIMITS[kind]
    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(F.nanvl(v, F.lit(0.0))))).cast({"uint8": "smallint", "uint16": "int"}.get(kind, kind))


def rescale(v: Column, low: Column, high: Column, new_low: float, new_high: float) -> Column:
    """Linear map of [low, high] to the new range, clamped; NaN stays."""
    span = F.when(high > low, high - low).otherwise(1.0)
    moved = (F.greatest(low, F.least(high, v)) - low) / span * (new_high - new_low) + new_low
    return F.when(F.isnan(v), v).otherwise(moved)


def scaled(raw: Column, slope: Column, inter: Column) -> Column:
    """Stored value to real value: only a slope other than 0 scales."""
    return F.when(slope == 0, raw).otherwise(slope * raw + inter)


def combine(op: str, a: Column, b: Column) -> Column:
    return {"add": a + b, "sub": a - b, "mul": a * b, "div": divide(a, b), "min": F.least(a, b)}[op]


def gaussian(v: Column, mean: Column, var: Column) -> Column:
    return F.exp(-((v - mean) * (v - mean)) / (2 * var)) / F.sqrt(2 * math.pi * var)


def mixed_gaussian(v: Column, mean_a, mean_b, var_a, var_b, steps: int = 100) -> Column:
    """Mean density over mixtures of two classes, in `steps` equal shares."""
    share = lambda k: (k + 0.5) / steps
    term = lambda k: gaussian(v, share(k) * mean_a + (1 - share(k)) * mean_b, share(k) * share(k) * var_a + (1 - share(k)) * (1 - share(k)) * var_b)
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda acc, k: acc + term(k)) / steps


def normalized(values: Column) -> Column:
    """An array scaled to sum 1; zeros where the sum is 0."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(values, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def first_argmax(values: Column) -> Column:
    """1-based place of the first largest element."""
    return F.array_position(values, F.array_max(values)).cast("int")


def partial_volume(v: Column, label: Column, csf: float, gm: float, wm: float) -> tuple[Column, Column, Column]:
    """Shares of three tissues from a five-class label: 1 first, 2 first-second mix, 3 second, 4 second-third mix, 5 third."""
    mix = lambda low, high: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    first = F.when(label == 1, 1.0).when(label == 2, 1 - mix(csf, gm)).otherwise(0.0)
    third = F.when(label == 5, 1.0).when(label == 4, mix(gm, wm)).otherwise(0.0)
    second = F.when(label == 3, 1.0).when(label == 2, mix(csf, gm)).when(label == 4, 1 - mix(gm, wm)).otherwise(0.0)
    return first, second, third


def tukey(x: Column, sigma: float) -> Column:
    """Edge stopping: x (1 - (x/s)^2)^2 inside s, else 0."""
    return F.when(F.abs(x) < sigma, x * F.pow(1 - F.pow(x / sigma, 2.0), 2.0)).otherwise(0.0)


def cubic_spline(x: Column) -> Column:
    a = F.abs(x)
    return F.when(a < 1, 2 / 3 + (a / 2 - 1) * a * a).when(a < 2, -F.pow(a - 2, 3.0) / 6).otherwise(0.0)


def cubic_spline_slope(x: Column) -> Column:
    a = F.abs(x)
    return F.signum(x) * F.when(a < 1, (1.5 * a - 2) * a).when(a < 2, -F.pow(a - 2, 2.0) / 2).otherwise(0.0)


def scaled_bessel_i(x: Column, order: int, terms: int = 60) -> Column:
    """exp(-x) times the modified Bessel function of the first kind, x >= 0: its power series up to 20, its asymptotic one beyond."""
    half = F.least(x, F.lit(20.0)) / 2

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * half * half / (k * (k + order))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    first = F.pow(half, float(order)) / math.factorial(order)
    near = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(first.alias("term"), first.alias("sum")), step, lambda acc: acc["sum"]) * F.exp(-2 * half)
    large = F.greatest(x, F.lit(20.0))
    term, far = F.lit(1.0), F.lit(1.0)
    for k in range(1, 16):
        term = term * (((2 * k - 1) ** 2 - 4 * order * order) / (8.0 * k)) / large
        far = far + term
    return F.when(x <= 20, near).otherwise(far / F.sqrt(2 * math.pi * large))


def rician_factor(snr: Column) -> Column:
    """Correction of the noise variance of a magnitude image at this signal to noise ratio; 1 where it leaves 0.001 to 10."""
    q = snr * snr / 4
    core = (2 + snr * snr) * scaled_bessel_i(q, 0) + snr * snr * scaled_bessel_i(q, 1)
    found = 2 + snr * snr - math.pi / 8 * core * core
    return F.when((found < 0.001) | (found > 10), 1.0).otherwise(found)


def world(matrix: list[list[float]], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A 4 x 4 matrix applied to a coordinate."""
    return tuple(matrix[r][0] * x + matrix[r][1] * y + matrix[r][2] * z + matrix[r][3] for r in range(3))
