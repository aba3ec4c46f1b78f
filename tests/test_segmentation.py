"""Expectation maximisation of volumes, against numpy and against known tissue."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import segmentation


def table(spark, volumes):
    rows = []
    for t, channels in volumes.items():
        n = channels.shape[1]
        for i in range(channels[0].size):
            rows.append((t, i, i % n, i // n % n, i // (n * n), *(float(c.ravel()[i]) for c in channels)))
    names = ", ".join(f"c{k} double" for k in range(len(next(iter(volumes.values())))))
    return spark.createDataFrame(rows, f"t long, i int, x int, y int, z int, {names}")


def test_rounds_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.where(rng.random((5, 5, 5)) < 0.4, rng.normal(1, 0.2, (5, 5, 5)), rng.normal(2, 0.3, (5, 5, 5)))
    d = table(spark, {4: v[None]})
    got = {r.i: r for r in segmentation.segment(d.withColumn("label", F.lit("own")), 2, ["c0"], rounds=4, tolerance=-1.0).collect()}
    y = v.ravel()
    marks = d.select(F.percentile_approx("c0", [0.25, 0.75], 1000)).first()[0]
    share, mean, var = np.full(2, 0.5), np.array(marks), np.full(2, y.var() / 4 + segmentation.LEAST_VARIANCE)
    for _ in range(4):
        w = share * np.exp(-0.5 * (y[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var)
        p = w / w.sum(1, keepdims=True)
        share, mean = p.mean(0), (p * y[:, None]).sum(0) / p.sum(0)
        var = (p * (y[:, None] - mean) ** 2).sum(0) / p.sum(0) + segmentation.LEAST_VARIANCE
    assert np.allclose([got[i].p for i in range(125)], p, atol=1e-6)
    assert [got[i].label for i in range(125)] == (p.argmax(1) + 1).tolist()


def test_two_channels_bias_neighbourhood_and_outliers(spark):
    rng = np.random.default_rng(2)
    n = 8
    z, y, x = np.indices((n, n, n))
    truth = (x + y // 2 > n // 2 + 1).astype(int)
    field = 0.5 * (x - (n - 1) / 2) / n + 0.3 * (y - (n - 1) / 2) / n
    one = 1.0 + 0.8 * truth + field + rng.normal(0, 0.15, truth.shape)
    two = np.where(truth, 0.0, 1.0) + rng.normal(0, 0.3, truth.shape)
    one[0, 0, 0] = 9.0
    other = np.stack([2.0 + truth + rng.normal(0, 0.1, truth.shape), two])
    d = table(spark, {0: np.stack([one, two]), 9: other})
    d = d.union(spark.createDataFrame([(0, 100000, 50, 50, 50, float("nan"), 1.0)], d.schema))
    got = segmentation.segment(d, 2, ["c0", "c1"], (n, n, n), beta=0.3, bias_order=1, outliers=3.0, rounds=12).collect()
    first = sorted((r for r in got if r.t == 0 and r.i < n**3), key=lambda r: r.i)
    assert np.mean([r.label - 1 for r in first] == truth.ravel()) > 0.98
    assert np.corrcoef([r.bias for r in first], field.ravel())[0, 1] > 0.95
    assert first[0].typical < 0.05 and np.median([r.typical for r in first]) > 0.9
    assert np.mean([r.label - 1 for r in sorted((r for r in got if r.t == 9), key=lambda r: r.i)] == truth.ravel()) > 0.99
    assert [r.p for r in got if r.i == 100000] == [None]


def test_prior_and_pull(spark):
    v = np.r_[np.full(60, 1.0), np.full(65, 1.2)].reshape(1, 5, 5, 5)
    d = table(spark, {0: v}).withColumns({"a": F.when(F.col("i") < 30, 0.99).otherwise(0.01), "b": F.when(F.col("i") < 30, 0.01).otherwise(0.99)})
    got = {r.i: r.label for r in segmentation.segment(d, 2, ["c0"], prior=["a", "b"], pull=1e6, rounds=3).collect()}
    assert all(got[i] == 1 for i in range(30)) and all(got[i] == 2 for i in range(60, 125))
    assert segmentation.segment(d.limit(0), 2, ["c0"]).count() == 0
