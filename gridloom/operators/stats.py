"""Statistics of volumes, slices and labels. NaN is missing everywhere; a mask keeps voxels above 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.voxelwise import above
from gridloom.operators.tables import cut

KEY = ["t"]
#: Labels that may be made dense, 0 to the largest.
MOST_LABELS = 1024


def _dense(top: Column) -> Column:
    """0 to the largest label; an error where that is too large to be one."""
    return F.explode(F.when(top <= MOST_LABELS, F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(top, F.lit(MOST_LABELS))))).otherwise(F.split(F.raise_error(F.concat(top.cast("string"), F.lit(f" labels are more than {MOST_LABELS}"))), "").cast("array<int>")))


def valid(voxels: DataFrame) -> DataFrame:
    return voxels.where(~F.isnan("v"))


def masked(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels where the mask (i, v) is above 0, at every time point."""
    return voxels.join(mask.where(above(F.col("v"), 0)).select("i"), "i", "left_semi")


def summary(voxels: DataFrame, by: list[str] = KEY, voxel_size: float = 1.0) -> DataFrame:
    """All one-pass statistics at once: mean, population deviation, range, counts, volumes, sums."""
    v = F.col("v")
    positive = F.when(v > 0, 1).otherwise(0)
    return valid(voxels).groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"),
        F.sum(positive).alias("n_positive"), (F.sum(positive) * voxel_size).alias("volume"), F.sum(v).alias("total"), (F.sum(v) * voxel_size).alias("soft_volume"),
    )


def order_statistics(voxels: DataFrame, ranks: dict[str, Column], by: list[str] = KEY) -> DataFrame:
    """The voxel of each named 0-based rank; a rank may use the column n."""
    placed = valid(voxels).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("v")) - 1).withColumn("n", F.count("v").over(Window.partitionBy(*by)))
    return placed.groupBy(*by).agg(*[F.max(F.when(F.col("_k") == rank.cast("bigint"), F.col("v"))).alias(name) for name, rank in ranks.items()])


def percentile(voxels: DataFrame, percent: float, by: list[str] = KEY) -> DataFrame:
    return order_statistics(voxels, {"percentile": F.floor(percent / 100 * (F.col("n") - 1))}, by)


def robust_range(voxels: DataFrame, share: float = 0.02, by: list[str] = KEY) -> DataFrame:
    last = F.col("n") - 1
    return order_statistics(voxels, {"low": F.round(share * last), "high": F.round((1 - share) * last)}, by)


def label_volumes(voxels: DataFrame, by: list[str] = KEY, voxel_size: float = 1.0) -> DataFrame:
    """Volume of every rounded value from 0 to the largest, empty ones too."""
    counts = valid(voxels).groupBy(*by, F.round("v").cast("int").alias("value")).agg(F.count("v").alias("n")).where("value >= 0")
    dense = counts.groupBy(*by).agg(F.max("value").alias("_top")).select(*by, _dense(F.col("_top")).alias("value"))
    return dense.join(counts, [*by, "value"], "left").select(*by, "value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.coalesce("n", F.lit(0)) * voxel_size).alias("volume"))


def label_means(values: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean of values (i, v) over each label of labels (i, label), 0 to the largest."""
    found = valid(values).join(labels, "i").groupBy("label").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    dense = labels.agg(F.max("label").alias("_top")).where("_top is not null").select(_dense(F.col("_top").cast("int")).alias("label"))
    return dense.join(found, "label", "left").select("label", "mean", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def dice(a: DataFrame, b: DataFrame, at_least: float | None = None) -> DataFrame:
    """Per label twice the common voxels over both counts of a and b (keys, label); 1 label is 1 row."""
    keys = [c for c in a.columns if c != "label"]
    both = a.join(b.withColumnRenamed("label", "_other"), keys)
    long = both.select(F.explode(F.array(F.struct(F.col("label").alias("label"), F.lit(1).alias("a"), F.lit(0).alias("b"), (F.col("label") == F.col("_other")).cast("int").alias("both")), F.struct(F.col("_other").alias("label"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("both")))).alias("_r")).select("_r.*")
    out = long.groupBy("label").agg((2 * F.sum("both") / (F.sum("a") + F.sum("b"))).alias("dice"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum("both").alias("n_both"))
    return out if at_least is None else out.where(F.col("dice") > at_least)


def confusion(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [c for c in a.columns if c != "label"]
    return a.join(b.withColumnRenamed("label", "other"), keys).groupBy("label", "other").agg(F.count("label").alias("n"))


def entropy(voxels: DataFrame, by: list[str] = KEY) -> DataFrame:
    """-sum p ln p over p = v / max of the positive voxels, and the same by the number of voxels."""
    top = valid(voxels).withColumn("_p", F.col("v") / F.max("v").over(Window.partitionBy(*by)))
    term = F.sum(F.when(F.col("v") > 0, -F.col("_p") * F.ln(F.when(F.col("v") > 0, F.col("_p"))))).alias("entropy")
    return top.groupBy(*by).agg(term, F.count("v").alias("_n")).withColumn("normed", F.col("entropy") / F.col("_n")).drop("_n")


def bounding_box(voxels: DataFrame, by: list[str] = KEY) -> DataFrame:
    """First coordinate and extent (last - first) of the voxels above 0."""
    return voxels.where(above(F.col("v"), 0)).groupBy(*by).agg(*[f for c in "xyz" for f in (F.min(c).alias(f"{c}min"), (F.max(c) - F.min(c)).alias(f"{c}size"))])


def centroid(voxels: DataFrame, by: list[str] = KEY) -> DataFrame:
    w = F.sum("v")
    return voxels.where(above(F.col("v"), 0)).groupBy(*by).agg(*[(F.sum(F.col(c) * F.col("v")) / w).alias(f"c{c}") for c in "xyz"])


def extreme_place(voxels: DataFrame, largest: bool = True, by: list[str] = KEY) -> DataFrame:
    """First voxel of the largest or least value."""
    order = F.col("v").desc() if largest else F.col("v")
    first = Window.partitionBy(*by).orderBy(order, "i")
    return valid(voxels).withColumn("_k", F.row_number().over(first)).where("_k = 1").select(*by, "x", "y", "z", "v")


def slices(voxels: DataFrame, axis: str, by: list[str] = KEY) -> DataFrame:
    return summary(voxels, [*by, axis])


def slice_image(voxels: DataFrame, axis: str, what: str = "mean", by: list[str] = KEY) -> DataFrame:
    """Every voxel replaced by its slice's mean, std or volume."""
    w = Window.partitionBy(*by, axis)
    v = F.when(~F.isnan("v"), F.col("v"))
    return voxels.withColumn("v", {"mean": F.avg(v).over(w), "std": F.stddev_pop(v).over(w), "volume": F.sum(F.when(v > 0, 1.0).otherwise(0.0)).over(w)}[what])


def over_time(voxels: DataFrame) -> DataFrame:
    """Mean, largest, least and place of the (first) largest value over t, per voxel, and the sample deviation."""
    v = valid(voxels)
    return v.groupBy("i").agg(F.avg("v").alias("tmean"), F.max("v").alias("tmax"), F.min("v").alias("tmin"), F.min_by("t", F.struct(-F.col("v"), F.col("t"))).alias("tpmax"), F.stddev_samp("v").alias("tstd"))


def z_scores(voxels: DataFrame) -> DataFrame:
    """Per image the mean over voxels of squared distance to the average image, over its sample deviation."""
    stats = valid(voxels).groupBy("i").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    joined = valid(voxels).join(stats, "i").where("_s > 0 and not isnan(_s)")
    return joined.groupBy("t").agg(F.avg((F.col("v") - F.col("_m")) * (F.col("v") - F.col("_m")) / F.col("_s")).alias("z_score"))


def z_scored(voxels: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Every voxel less its volume's mean, over its population deviation."""
    w = Window.partitionBy(*by)
    v = F.when(~F.isnan("v"), F.col("v"))
    return voxels.withColumn("v", (F.col("v") - F.avg(v).over(w)) / F.nullif(F.stddev_pop(v).over(w), F.lit(0.0)))


def robust_z_scored(voxels: DataFrame, share: float, by: list[str] = KEY) -> DataFrame:
    """As z_scored() by mean and deviation of the voxels strictly between the order statistics of share and 1 - share."""
    bounds = robust_range(voxels, share, by)
    inner = voxels.join(bounds, by).where("v > low and v < high").groupBy(*by).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return voxels.join(inner, by).withColumn("v", (F.col("v") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def histogram(voxels: DataFrame, bins: int, by: list[str] = KEY) -> DataFrame:
    """Counts in `bins` equal bins from least to largest value; the largest is in the last."""
    w = Window.partitionBy(*by)
    low, high = F.min("v").over(w), F.max("v").over(w)
    place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("_low")) / F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0) * bins)).cast("int")
    return valid(voxels).withColumns({"_low": low, "_high": high}).withColumn("bin", place).groupBy(*by, "bin").agg(F.count("v").alias("n"), F.min("_low").alias("low"), F.min("_high").alias("high"))


def histogram_percentile(voxels: DataFrame, percent: float, bins: int = 10000, by: list[str] = KEY) -> DataFrame:
    """Lower edge of the first bin at which the cumulative count exceeds the share."""
    h = histogram(voxels, bins, by)
    w = Window.partitionBy(*by)
    at = h.withColumn("_c", F.sum("n").over(w.orderBy("bin"))).withColumn("_n", F.sum("n").over(w)).where(F.col("_c") >= F.col("_n") * (percent / 100))
    return at.groupBy(*by).agg((F.min("low") + F.min("bin") * (F.min("high") - F.min("low")) / bins).alias("percentile"))


def otsu(voxels: DataFrame, bins: int = 256, by: list[str] = KEY) -> DataFrame:
    """Bin that parts the histogram with the largest variance between both classes; ties take the first."""
    h = histogram(voxels, bins, by)
    w = Window.partitionBy(*by).orderBy("bin")
    all_ = Window.partitionBy(*by)
    c = h.withColumn("_w", F.sum("n").over(w)).withColumn("_s", F.sum(F.col("n") * F.col("bin")).over(w)).withColumn("_all", F.sum("n").over(all_)).withColumn("_sum", F.sum(F.col("n") * F.col("bin")).over(all_))
    rest = F.col("_all") - F.col("_w")
    gap = F.col("_s") / F.col("_w") - F.try_divide(F.col("_sum") - F.col("_s"), rest)
    scored = c.where(rest > 0).withColumn("between", F.col("_w") * rest * gap * gap)
    best = Window.partitionBy(*by).orderBy(F.col("between").desc(), "bin")
    return scored.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*by, "bin", "between")


def ncc(a: DataFrame, b: DataFrame) -> DataFrame:
    """Normalised correlation of every image of a with the single image b (i, v)."""
    return _pairs(a, b).groupBy("t").agg((F.covar_pop("v", "w") / (F.stddev_pop("v") * F.stddev_pop("w") + 1e-7)).alias("ncc"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return valid(a).join(valid(b).select("i", F.col("v").alias("w")), "i")


def ssd(a: DataFrame, b: DataFrame) -> DataFrame:
    return _pairs(a, b).groupBy("t").agg(F.ln(F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))) + 1).alias("ssd"))


def joint_entropies(a: DataFrame, b: DataFrame, bins: int) -> DataFrame:
    """Entropies of both images and of their joint histogram, values being bins already, and (H(a) + H(b)) / H(a, b)."""
    pairs = _pairs(a, b).where(f"v >= 0 and v < {bins} and w >= 0 and w < {bins}").select("t", F.floor("v").alias("p"), F.floor("w").alias("q"))
    joint = pairs.groupBy("t", "p", "q").agg(F.count("p").alias("n"))
    w = Window.partitionBy("t")
    h = lambda name: (-F.sum(F.col(name) * F.ln(name)))
    total = joint.withColumn("_all", F.sum("n").over(w))
    hj = total.withColumn("_p", F.col("n") / F.col("_all")).groupBy("t").agg(h("_p").alias("h_joint"))
    one = lambda c, name: total.groupBy("t", c, "_all").agg(F.sum("n").alias("n")).withColumn("_p", F.col("n") / F.col("_all")).groupBy("t").agg(h("_p").alias(name))
    return one("p", "h_a").join(one("q", "h_b"), "t").join(hj, "t").withColumn("nmi", F.try_divide(F.col("h_a") + F.col("h_b"), F.col("h_joint")))


def mean_rms(fields: DataFrame) -> DataFrame:
    """Mean over voxels of the length across components u of fields (t, i, u, v)."""
    return valid(fields).groupBy("t", "i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_l")).groupBy("t").agg(F.avg("_l").alias("mean_rms"), F.max("_l").alias("max_length"))


def line_fit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Least-squares w = slope v + intercept of every image of a against b."""
    return _pairs(a, b).groupBy("t").agg(F.regr_slope("w", "v").alias("slope"), F.regr_intercept("w", "v").alias("intercept"))


def line_normalized(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(line_fit(a, b), "t").withColumn("v", F.col("slope") * F.col("v") + F.col("intercept")).drop("slope", "intercept")


def trimmed_line_fit(a: DataFrame, b: DataFrame, keep: float = 0.5, rounds: int = 5) -> DataFrame:
    """Line fit again and again on the share of voxels with the least residuals."""
    pairs = _pairs(a, b).select("t", "i", "v", "w")
    fit = pairs.groupBy("t").agg(F.regr_slope("w", "v").alias("slope"), F.regr_intercept("w", "v").alias("intercept"))
    for _ in range(rounds):
        residual = F.abs(F.col("w") - (F.col("slope") * F.col("v") + F.col("intercept")))
        ranked = pairs.join(fit, "t").withColumn("_r", F.percent_rank().over(Window.partitionBy("t").orderBy(residual, "i")))
        fit = ranked.where(F.col("_r") <= keep).groupBy("t").agg(F.regr_slope("w", "v").alias("slope"), F.regr_intercept("w", "v").alias("intercept"))
    return fit


def trimmed_line_normalized(a: DataFrame, b: DataFrame, keep: float = 0.5, rounds: int = 5) -> DataFrame:
    return a.join(trimmed_line_fit(a, b, keep, rounds), "t").withColumn("v", F.col("slope") * F.col("v") + F.col("intercept")).drop("slope", "intercept")


def polynomial_sums(a: DataFrame, b: DataFrame, order: int) -> DataFrame:
    """Normal-equation sums of v^k and v^k w, k up to 2 order and order: one pass, one row an image."""
    v, w = F.col("v"), F.col("w")
    return _pairs(a, b).groupBy("t").agg(*[F.sum(F.pow(v, float(k))).alias(f"s{k}") for k in range(2 * order + 1)], *[F.sum(F.pow(v, float(k)) * w).alias(f"r{k}") for k in range(order + 1)])


def polynomial_fit(a: DataFrame, b: DataFrame, order: int = 2) -> DataFrame:
    """Coefficients, constant first, of the least-squares polynomial of each image against b."""
    order = max(1, min(4, order))

    def solve(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                s = [getattr(row, f"s{k}") for k in range(2 * order + 1)]
                m = np.array([[s[i + j] for j in range(order + 1)] for i in range(order + 1)])
                out.append(np.linalg.lstsq(m, np.array([getattr(row, f"r{k}") for k in range(order + 1)]), rcond=None)[0].tolist())
            yield pdf[["t"]].assign(coefficients=out)

    return polynomial_sums(a, b, order).mapInPandas(solve, "t long, coefficients array<double>")


def _applied(a: DataFrame, fit: DataFrame) -> DataFrame:
    """Every voxel through its volume's polynomial (t, coefficients)."""
    value = F.aggregate(F.reverse("coefficients"), F.lit(0.0), lambda acc, c: acc * F.col("v") + c)
    return a.join(fit, "t").withColumn("v", value).drop("coefficients")


def polynomial_normalized(a: DataFrame, b: DataFrame, order: int = 2) -> DataFrame:
    return _applied(a, polynomial_fit(a, b, order))


def masked_normalized(a: DataFrame, b: DataFrame, mask: DataFrame, fit) -> DataFrame:
    """All voxels through a fit(a, b) of polynomials that is made inside the mask (i, v) only."""
    return _applied(a, fit(masked(a, mask), masked(b, mask)))


def ranked(voxels: DataFrame) -> DataFrame:
    """v, rank from 0 in ascending order over the whole table and n, by range partitions: no task sorts all of it."""
    ranged = cut(valid(voxels).select("v").repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    before, total = {}, 0
    for part, n in sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect()):  # a row a partition
        before[part], total = total, total + n
    if not total:
        return ranged.select("v", F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("n"))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    return ranged.select("v", (base + F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1).cast("bigint").alias("rank"), F.lit(total).cast("bigint").alias("n"))


def quantile_fit(a: DataFrame, b: DataFrame, points: int = 1000, order: int = 1) -> DataFrame:
    """Polynomial fit of b's order statistics on those of each image of a."""
    w = Window.partitionBy("t")
    placed = valid(a).select("t", "v").withColumns({"rank": (F.row_number().over(w.orderBy("v")) - 1).cast("bigint"), "n": F.count("v").over(w)})

    def at(d: DataFrame, by: list[str], name: str) -> DataFrame:
        wanted = d.select(*by, "n").distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), F.col("n"))
        wanted = wanted.select(*by, "i", F.floor(F.col("i") / points * (F.col("n") - 1)).alias("rank"))
        return d.join(wanted, [*by, "rank"]).select(*by, "i", F.col("v").alias(name))

    return polynomial_fit(at(placed, ["t"], "v"), at(ranked(b), [], "v"), order)


def quantile_matched(a: DataFrame, b: DataFrame, points: int = 1000, order: int = 1) -> DataFrame:
    return _applied(a, quantile_fit(a, b, points, order))
