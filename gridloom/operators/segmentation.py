"""Segmentation by one expectation maximisation that estimates classes, neighbourhood and bias together, volume by volume.

Every volume t has its own parameters, which are rows of a table: a round is one pass over the voxels (chances, and one
aggregate of their sums a volume) and Arrow batches of one row a volume that turn sums into means and covariances.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.bias import bias_field
from gridloom.operators.stencil import AXES, line
from gridloom.operators.tables import cut, release, tidy

#: Added to every variance, in the units of the (logarithmic) values.
LEAST_VARIANCE = 1e-6
PARAMETERS = "t long, share array<double>, mean array<array<double>>, precision array<array<double>>, logdet array<double>"


def logarithm(v: Column) -> Column:
    """ln(v + 1), values below 0 counting as 0: a product with a bias field becomes a sum."""
    return F.ln(F.greatest(v, F.lit(0.0)) + 1)


def _settled(mean: np.ndarray, cov: np.ndarray, share: np.ndarray) -> dict:
    """A volume's parameters as a row: inverse covariances are flattened."""
    d = mean.shape[1]
    cov = cov + LEAST_VARIANCE * np.eye(d)
    return {"share": share.tolist(), "mean": mean.tolist(), "precision": [np.linalg.inv(c).ravel().tolist() for c in cov], "logdet": [float(np.linalg.slogdet(c)[1]) for c in cov]}


def _first(channels: list[str], classes: int):
    """Parameters from each volume's quantiles of the first channel, or from sums under the prior (see _sums)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for t, marks, means, variances in zip(pdf.t, pdf.marks, pdf.means, pdf.variances, strict=True):
                mean = np.tile(np.asarray(means, float), (classes, 1))
                mean[:, 0] = marks
                cov = np.array([np.diag(np.asarray(variances, float) / classes**2)] * classes)
                rows.append({"t": t} | _settled(mean, cov, np.full(classes, 1 / classes)))
            yield pd.DataFrame(rows)

    return run


def _maximised(channels: int, classes: int, pull: float):
    """Sums of one round to parameters; pull draws each class's mean towards its first one by so many voxels (MAP)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n0 = np.asarray(r.n, float)
                n = np.maximum(n0, 1e-9)
                first = np.array([list(m) for m in r.first_mean])
                s = np.asarray(r.s, float).reshape(classes, channels)
                q = np.asarray(r.q, float).reshape(classes, channels, channels)
                mean = (s + pull * first) / (n + pull)[:, None]
                cov = q / n[:, None, None] - mean[:, :, None] * (s / n[:, None])[:, None, :] - (s / n[:, None])[:, :, None] * mean[:, None, :] + mean[:, :, None] * mean[:, None, :]
                cov = (cov + cov.transpose(0, 2, 1)) / 2
                width = np.linalg.eigvalsh(cov).min(1)
                cov += np.maximum(0, LEAST_VARIANCE - width)[:, None, None] * np.eye(channels)
                rows.append({"t": r.t} | _settled(mean, cov, n / n.sum()))
            yield pd.DataFrame(rows)

    return run


def _densities(channels: list[str], classes: int, prior: list[str] | None) -> list[Column]:
    """share * prior * Gaussian density of each class."""
    d = len(channels)
    out = []
    for k in range(classes):
        gap = [F.col(c) - F.col("mean")[k][j] for j, c in enumerate(channels)]
        far = sum((gap[i] * gap[j] * F.col("precision")[k][i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))
        density = F.exp(-0.5 * (far + F.col("logdet")[k] + d * float(np.log(2 * np.pi))))
        out.append(F.col("share")[k] * density * (F.col(prior[k]) if prior else F.lit(1.0)))
    return out


def _neighbourhood(voxels: DataFrame, classes: int, beta: float) -> DataFrame:
    """_e: exp(-beta * chance of other classes over the face neighbours) of each class, by frames of one shuffle."""
    near = F.array(*[F.lit(0.0)] * classes)
    for axis in AXES:
        for f in (F.lag("p", 1).over(line(axis)), F.lead("p", 1).over(line(axis))):
            near = F.zip_with(near, F.coalesce(f, F.array(*[F.lit(0.0)] * classes)), lambda a, b: a + b)
    out = voxels.withColumn("_near", near).withColumn("_all", F.aggregate("_near", F.lit(0.0), lambda a, x: a + x))
    return out.withColumn("_e", F.transform("_near", lambda x: F.exp(-beta * (F.col("_all") - x)))).drop("_near", "_all")


@tidy
def segment(
    voxels: DataFrame,
    classes: int,
    channels: list[str] | None = None,
    shape: tuple[int, int, int] | None = None,
    prior: list[str] | None = None,
    beta: float = 0.0,
    bias_order: int = 0,
    outliers: float = 0.0,
    pull: float = 0.0,
    rounds: int = 30,
    tolerance: float = 1e-4,
) -> DataFrame:
    """voxels (t, i, x, y, z, channels, ...) with p (chances of the classes), label (1 .. classes, the likeliest), bias (that of
    the first channel) and typical (1, or less for outliers).

    prior names columns of voxelwise class chances; beta is the strength of the neighbourhood, bias_order the order of the
    polynomial field that is taken off the first channel (0: none; needs shape), outliers the Mahalanobis distance beyond which
    a voxel counts less and less (0: none), pull the weight in voxels of the first means. Rounds end when no volume's
    log-likelihood grows by more than the tolerance. Rows with a null or NaN channel get no chances. Classes are in ascending
    order of their first means; columns of voxels with the result's names are replaced.
    """
    channels = channels or ["v"]
    sound = F.lit(True)
    for c in channels:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c)
    data = [f"_y{j}" for j in range(len(channels))]
    given = [f"_g{k}" for k in range(classes)] if prior else None
    columns = [F.col(c).cast("double").alias(n) for n, c in zip([*data, *(given or [])], [*channels, *(prior or [])], strict=True)]
    work = voxels.where(sound).select("t", "i", *AXES, *columns).repartition("t")
    work = cut(work.withColumns({"bias": F.lit(0.0), "p": F.array(*[F.lit(1 / classes)] * classes)}))
    marks = F.percentile_approx(data[0], [(k + 0.5) / classes for k in range(classes)], 1000)
    start = work.groupBy("t").agg(marks.alias("marks"), F.array(*[F.avg(y) for y in data]).alias("means"), F.array(*[F.greatest(F.var_pop(y), F.lit(LEAST_VARIANCE)) for y in data]).alias("variances"))
    params = first = cut(start.mapInPandas(_first(channels, classes), PARAMETERS))
    before = None
    for turn in range(rounds):
        known = work.join(params, "t")
        if beta and turn:
            known = _neighbourhood(known, classes, beta)
            raw = [w * F.col("_e")[k] for k, w in enumerate(_densities(data, classes, given))]
        else:
            raw = _densities(data, classes, given)
        told = known.withColumn("_w", F.array(*raw)).withColumn("_sum", F.aggregate("_w", F.lit(0.0), lambda a, x: a + x))
        p = F.transform("_w", lambda x: F.when(F.col("_sum") > 0, x / F.col("_sum")).otherwise(1 / classes))
        told = told.withColumn("p", p)
        if outliers:
            limit = float(np.exp(-0.5 * outliers**2))
            peak = F.aggregate(F.zip_with("p", F.col("logdet"), lambda a, b: a * F.exp(-0.5 * (b + len(data) * float(np.log(2 * np.pi))))), F.lit(0.0), lambda a, x: a + x)
            told = told.withColumn("typical", F.col("_sum") / (F.col("_sum") + limit * peak * F.array_max("share")))
        else:
            told = told.withColumn("typical", F.lit(1.0))
        told = cut(told.drop("share", "mean", "precision", "logdet", "_w", "_e"))
        weight = lambda k: F.col("p")[k] * F.col("typical")
        sums = told.groupBy("t").agg(
            F.sum(F.ln(F.greatest(F.col("_sum"), F.lit(1e-300)))).alias("likelihood"),
            F.array(*[F.sum(weight(k)) for k in range(classes)]).alias("n"),
            F.array(*[F.sum(weight(k) * F.col(y)) for k in range(classes) for y in data]).alias("s"),
            F.array(*[F.sum(weight(k) * F.col(y) * F.col(z)) for k in range(classes) for y in data for z in data]).alias("q"),
        )
        sums = cut(sums)
        params = cut(sums.join(first.select("t", F.col("mean").alias("first_mean")), "t").mapInPandas(_maximised(len(data), classes, pull), PARAMETERS))
        release(work)
        work = told.drop("_sum")
        if bias_order:
            work = _unbiased(work, params, classes, data[0], shape, bias_order)
        after = sums.select("t", "likelihood")
        if before is not None and after.join(before.withColumnRenamed("likelihood", "_l"), "t").where(F.col("likelihood") - F.col("_l") > tolerance * F.abs(F.col("_l"))).isEmpty():
            break
        before = after
    label = F.array_position(F.transform("p", lambda x: F.round(x, 12)), F.array_max(F.transform("p", lambda x: F.round(x, 12)))).cast("int")
    done = work.select("t", "i", "p", label.alias("label"), "bias", "typical")
    return voxels.drop("p", "label", "bias", "typical").join(done, ["t", "i"], "left")


def _unbiased(work: DataFrame, params: DataFrame, classes: int, value: str, shape: tuple[int, int, int] | None, order: int) -> DataFrame:
    """The first channel less a smooth field that fits what the classes' means leave, weighted by precision."""
    if shape is None:
        raise ValueError("a bias field needs the shape of the volumes")
    known = work.join(params.select("t", "mean", "precision"), "t")
    weight = [F.col("p")[k] * F.col("typical") * F.col("precision")[k][0] for k in range(classes)]
    total = sum(weight, F.lit(0.0))
    level = sum((w * F.col("mean")[k][0] for k, w in enumerate(weight)), F.lit(0.0)) / F.greatest(total, F.lit(1e-12))
    rest = known.select("t", "i", "x", "y", "z", (F.col(value) + F.col("bias") - level).alias("v"), total.alias("w"))
    field = bias_field(rest, shape, order).withColumn("_b", F.col("bias") - F.avg("bias").over(Window.partitionBy("t"))).select("t", "i", "_b")
    moved = work.join(field, ["t", "i"]).withColumn(value, F.col(value) + F.col("bias") - F.col("_b")).withColumn("bias", F.col("_b")).drop("_b")
    out = cut(moved)
    release(work)
    return out
