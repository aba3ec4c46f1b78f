"""Kernels over stacks of small volumes: as volume by volume, several volumes a group."""

import numpy as np

from gridloom.operators import kernels


def test_stacks_give_what_single_volumes_give():
    rng = np.random.default_rng(0)
    mask = np.zeros((5, 4, 6), bool)
    mask[1:4, 1:3, 1:5] = True
    a = rng.normal(size=(3, 5, 4, 6))
    a[1, 0, 0, 0] = np.nan
    a[2] = np.round(a[2])
    for kernel in (kernels.patch_fill(mask), kernels.non_local_means(0.2)):
        assert np.array_equal(kernel(a), np.stack([kernel(x) for x in a]), equal_nan=True)
    copy = np.tile(np.arange(6.0), (5, 4, 1))
    flat = np.where(mask, 9.0, copy * 0)
    assert (kernels.patch_fill(mask)(flat) == 0).all()


def test_a_group_holds_several_volumes(spark):
    sizes = []

    def kernel(a):
        return a * 0 + len(a)

    d = spark.range(100 * 64).selectExpr("id div 64 - 20 as t", "cast(id % 64 as int) as i", "1.0D as v")
    for r in kernels.per_stack(d, (4, 4, 4), kernel).groupBy("t").agg({"v": "max", "i": "count"}).toDF("t", "v", "n").collect():
        assert r.n == 64
        sizes.append(r.v)
    assert len(sizes) == 100 and max(sizes) > 1
