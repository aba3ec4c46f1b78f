"""Ranking of images and voxels, and label fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.stats import ncc
from gridloom.operators.tables import cut, release


def top_ncc(images: DataFrame, target: DataFrame, k: int) -> DataFrame:
    """The k images most alike the target; ties take the least t."""
    return ncc(images, target).orderBy(F.col("ncc").desc(), "t").limit(k)


def roi_ncc(images: DataFrame, target: DataFrame, region: DataFrame, k: int) -> DataFrame:
    """As top_ncc() inside the region (i)."""
    return top_ncc(images.join(region, "i", "left_semi"), target, k)


def top_each_voxel(scores: DataFrame, score: str, k: int, largest: bool = True) -> DataFrame:
    """Per voxel the k images with the best local score."""
    order = F.col(score).desc() if largest else F.col(score)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(order, "t"))).where(F.col("rank") <= k)


def block_variances(voxels: DataFrame, side: int, keep: float) -> DataFrame:
    """Blocks of side^3 voxels with the share `keep` of largest variances of each image."""
    blocks = voxels.groupBy("t", *[F.expr(f"{a} div {side}").cast("int").alias(f"b{a}") for a in "xyz"]).agg(F.var_pop("v").alias("var"), F.count("v").alias("n"))
    w = Window.partitionBy("t")
    ranked = blocks.withColumn("_k", F.row_number().over(w.orderBy(F.col("var").desc(), "bz", "by", "bx"))).withColumn("_n", F.count("var").over(w))
    return ranked.where(F.col("_k") <= F.ceil(F.col("_n") * keep)).drop("_k", "_n")


def majority(votes: DataFrame) -> DataFrame:
    """Most voted label of each voxel of votes (i, rater, label); ties take the least label."""
    counts = votes.groupBy("i", "label").agg(F.count("rater").alias("n"))
    total = counts.withColumn("_all", F.sum("n").over(Window.partitionBy("i")))
    best = total.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy(F.col("n").desc(), "label")))
    return best.where("_k = 1").select("i", "label", "n", (F.col("n") / F.col("_all")).alias("share"))


def uncertain(votes: DataFrame, share: float = 1.0) -> DataFrame:
    """Voxels in which no label has the given share of the votes."""
    counts = votes.groupBy("i", "label").agg(F.count("rater").alias("n"))
    return counts.groupBy("i").agg(F.max("n").alias("n"), F.sum("n").alias("all")).where(F.col("n") < F.ceil(F.col("all") * share)).select("i")


def staple(votes: DataFrame, labels: int, rounds: int = 15, tolerance: float = 1e-5, start: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Expectation maximisation of every rater's confusion matrix: (i, label, p) and (rater, label decided, s true, theta).

    Matrices are tables like the votes, since there may be as many raters as volumes; only their mean agreement reaches the
    driver. Labels run from 0; one that no rater chose at a voxel gets 0 there.
    """
    held = cut(votes.select("i", "rater", "label").where(F.col("label").between(0, labels - 1)))
    every = F.sequence(F.lit(0), F.lit(labels - 1))
    off = (1 - start) / max(1, labels - 1)
    cells = cut(votes.select("rater").distinct()).withColumn("label", F.explode(every)).withColumn("s", F.explode(every))
    theta = cells.withColumn("theta", F.when(F.col("label") == F.col("s"), F.lit(start)).otherwise(off))
    w, trace, p = Window.partitionBy("i"), None, None
    for _ in range(rounds):
        share = held.join(theta.hint("merge"), ["rater", "label"]).groupBy("i", "s").agg(F.sum(F.ln("theta")).alias("l"), F.max((F.col("label") == F.col("s")).cast("int")).alias("voted"))
        weight = share.where("voted = 1").withColumn("_e", F.exp(F.col("l") - F.max("l").over(w)))
        before = (p, theta)
        p = cut(weight.withColumn("p", F.col("_e") / F.sum("_e").over(w)).select("i", "s", "p"))
        sums = held.join(p, "i").groupBy("rater", "label", "s").agg(F.sum("p").alias("w"))
        full = cells.join(sums.hint("merge"), ["rater", "label", "s"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)) + 1e-4)
        theta = cut(full.withColumn("theta", F.col("w") / F.sum("w").over(Window.partitionBy("rater", "s"))).drop("w"))
        found = theta.where("label = s").agg(F.avg("theta")).first()[0] or 0.0
        if before[0] is not None:
            release(*before)
        if trace is not None and abs(found - trace) <= tolerance * abs(trace):
            break
        trace = found
    return p.withColumnRenamed("s", "label"), theta


def shape_average(distances: DataFrame) -> DataFrame:
    """Label with the largest sum of d |d| over raters of distances (i, rater, label, d); ties take the last label, none above -1 is 0."""
    weights = distances.groupBy("i", "label").agg(F.sum(F.col("d") * F.abs("d")).alias("w"))
    best = weights.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy(F.col("w").desc(), F.col("label").desc())))
    return best.where("_k = 1").select("i", F.when(F.col("w") > -1, F.col("label")).otherwise(0).alias("label"))
