"""Smooth intensity fields, prior relaxation, smoothed mutual information."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.stats import valid


def _terms(order: int, shape: tuple[int, int, int]):
    """All products of powers of the coordinates, scaled to [-1, 1], of total order up to `order`."""
    scaled = [2 * F.col(a) / max(1, n - 1) - 1 for a, n in zip("xyz", shape, strict=True)]
    power = lambda c, k: F.lit(1.0) if k == 0 else F.pow(c, F.lit(float(k)))
    return [power(scaled[0], i) * power(scaled[1], j) * power(scaled[2], k) for i in range(order + 1) for j in range(order + 1 - i) for k in range(order + 1 - i - j)]


def bias_field(voxels: DataFrame, shape: tuple[int, int, int], order: int = 2, step: int = 1) -> DataFrame:
    """voxels with bias: the weighted least-squares polynomial of v (weight column w, or 1), fitted on every step-th voxel.

    One aggregate gives all normal sums of each volume; the small systems are solved in Arrow batches, one row a volume.
    """
    terms = _terms(order, shape)
    n = len(terms)
    weight = F.col("w") if "w" in voxels.columns else F.lit(1.0)
    sampled = valid(voxels).where(" and ".join(f"{a} % {step} = 0" for a in "xyz")).select("t", "v", weight.alias("_w"), F.array(*terms).alias("_f"))
    pair = [(i, j) for i in range(n) for j in range(i, n)]
    f = lambda i: F.col("_f")[i]
    sums = sampled.groupBy("t").agg(F.array(*[F.sum(F.col("_w") * f(i) * f(j)) for i, j in pair]).alias("_a"), F.array(*[F.sum(F.col("_w") * f(i) * F.col("v")) for i in range(n)]).alias("_b"))

    def solve(batches):
        for pdf in batches:
            out = []
            for a, b in zip(pdf._a, pdf._b, strict=True):
                m = np.zeros((n, n))
                for (i, j), x in zip(pair, a, strict=True):
                    m[i, j] = m[j, i] = x
                out.append(np.linalg.lstsq(m, np.asarray(b), rcond=None)[0].tolist())
            yield pdf[["t"]].assign(_c=out)

    fit = sums.mapInPandas(solve, "t long, _c array<double>")
    value = sum((F.col("_c")[i] * terms[i] for i in range(n)), F.lit(0.0))
    return voxels.join(fit, "t").withColumn("bias", value).drop("_c")


def relaxed_prior(smooth: DataFrame, prior: DataFrame, share: float) -> DataFrame:
    """(1 - share) of the smoothed chances (t, i, v) and share of the first prior (t, i, v)."""
    return smooth.join(prior.select("t", "i", F.col("v").alias("_p")), ["t", "i"]).withColumn("v", (1 - share) * F.col("v") + share * F.col("_p")).drop("_p")


def smoothed_nmi(a: DataFrame, b: DataFrame, bins: int = 68) -> DataFrame:
    """(H(a) + H(b)) / H(a, b) of the joint histogram of truncated values, smoothed by 1/6, 2/3, 1/6 along both axes."""
    pairs = valid(a).join(valid(b).select("i", F.col("v").alias("w")), "i").where(f"v >= 0 and v < {bins} and w >= 0 and w < {bins}")
    joint = pairs.groupBy("t", F.floor("v").cast("int").alias("p"), F.floor("w").cast("int").alias("q")).agg(F.count("v").cast("double").alias("n"))
    for axis in ("p", "q"):
        taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((-1, 1 / 6), (0, 2 / 3), (1, 1 / 6))])
        part = joint.withColumn("_k", F.explode(taps)).withColumn(axis, F.col(axis) + F.col("_k.d")).withColumn("n", F.col("n") * F.col("_k.w"))
        joint = part.where(f"{axis} between 0 and {bins - 1}").groupBy("t", "p", "q").agg(F.sum("n").alias("n"))
    share = joint.withColumn("_s", F.col("n") / F.sum("n").over(Window.partitionBy("t")))
    h = lambda d, by, name: d.groupBy("t", *by).agg(F.sum("_s").alias("_s")).groupBy("t").agg((-F.sum(F.col("_s") * F.ln("_s"))).alias(name))
    return h(share, ["p"], "h_a").join(h(share, ["q"], "h_b"), "t").join(h(share, ["p", "q"], "h_ab"), "t").withColumn("nmi", F.try_divide(F.col("h_a") + F.col("h_b"), F.col("h_ab")))
