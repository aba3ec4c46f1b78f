"""Every query of the grid operators by name, with the SQL that gives the same rows.

The embeddings are read as 4 x 4 x 4 volumes (t: vec_id); floating sums are rounded, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import voxelwise as vx
from gridloom.operators import bias, cluster, components, kernels, patches, ranking, registration, reshape, segmentation, stats, stencil
from gridloom.plans.chain import compile_chain
from gridloom.sources.voxels import test_volumes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "ncc_topk"

VOX = "WITH vox AS MATERIALIZED (SELECT vec_id t, label, (u - 1)::INT i, ((u - 1) % 4)::INT x, (((u - 1) // 4) % 4)::INT y, ((u - 1) // 16)::INT z, embedding[u]::DOUBLE v FROM embeddings, generate_series(1, 64) g(u)) "


def query(name: str, sql: str | None = None, raw: bool = False):
    """Register f(voxels, spark, sf_dir, v), v being the column of values; sql may use vox unless raw."""

    def run(f: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(test_volumes(spark, sf_dir), spark, sf_dir, F.col("v"))
        return out.withColumns({c: F.col(c) + 0.0 for c, kind in out.dtypes if kind == "double"})  # no negative zero

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: run(f, spark, sf_dir)
        if sql:
            ORACLE_SQL[name] = sql if raw else VOX + (", " + sql[5:] if sql.startswith("WITH ") else sql)
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


UNARY = {
    "vox_mul_scalar": (lambda v: v * 2.5, "v * 2.5::DOUBLE"), "vox_add_scalar": (lambda v: v + 0.25, "v + 0.25::DOUBLE"), "vox_sub_scalar": (lambda v: v - 0.25, "v - 0.25::DOUBLE"), "vox_div_scalar": (lambda v: vx.divide(v, F.lit(4.0)), "v / 4"),
    "vox_pow": (lambda v: r(F.pow(v, F.lit(3.0)), 9), "round(pow(v, 3), 9)"), "vox_sqrt": (lambda v: r(F.sqrt(F.abs(v)), 9), "round(sqrt(abs(v)), 9)"), "vox_exp": (lambda v: r(F.exp(v), 9), "round(exp(v), 9)"), "vox_log": (lambda v: r(vx.log(F.abs(v)), 9), "round(ln(abs(v)), 9)"),
    "vox_recip": (lambda v: r(vx.recip(v + 2), 9), "round(1 / (v + 2), 9)"), "vox_abs": (lambda v: F.abs(v), "abs(v)"), "vox_bin": (lambda v: vx.binarise(v), "CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END"), "vox_thr": (lambda v: vx.threshold(v, 0.05), "CASE WHEN v > 0.05::DOUBLE THEN v ELSE 0 END"),
    "vox_uthr": (lambda v: vx.upper_threshold(v, 0.05), "CASE WHEN v < 0.05::DOUBLE THEN v ELSE 0 END"), "vox_equal": (lambda v: vx.equal(F.round(v * 10), 1.0), "CASE WHEN round(v * 10) = 1 THEN 1.0::DOUBLE ELSE 0 END"), "vox_replace": (lambda v: vx.replace(F.round(v * 10), 1.0, 7.0), "CASE WHEN round(v * 10) = 1 THEN 7.0::DOUBLE ELSE round(v * 10) END"),
    "vox_removenan": (lambda v: vx.remove_nan(F.when(v < 0, F.lit(float("nan"))).otherwise(v)), "CASE WHEN v < 0 THEN 0 ELSE v END"), "vox_isnan": (lambda v: vx.is_nan(F.when(v < 0, F.lit(float("nan"))).otherwise(v)), "CASE WHEN v < 0 THEN 1.0::DOUBLE ELSE 0 END"), "vox_binarise_nonzero": (lambda v: vx.binarise_nonzero(F.round(v * 5)), "CASE WHEN round(v * 5) <> 0 THEN 1.0::DOUBLE ELSE 0 END"),
    "vox_signed_mask": (lambda v: vx.signed_mask(F.round(v * 5)), "CASE WHEN round(v * 5) <> 0 THEN 1 ELSE -1 END"), "vox_output_type": (lambda v: vx.output_type(v * 500, "uint8").cast("int"), "greatest(0, least(255, round(v * 500)))::INT"), "vox_scaled": (lambda v: vx.scaled(v, F.lit(2.0), F.lit(1.0)), "2.0::DOUBLE * v + 1"),
    "vox_gaussian": (lambda v: r(vx.gaussian(v, F.lit(0.1), F.lit(0.04)), 9), "round(exp(-((v - 0.1::DOUBLE) * (v - 0.1::DOUBLE)) / (2 * 0.04::DOUBLE)) / sqrt(2 * pi() * 0.04::DOUBLE), 9)"), "vox_tukey": (lambda v: r(vx.tukey(v, 0.2), 9), "round(CASE WHEN abs(v) < 0.2::DOUBLE THEN v * pow(1 - pow(v / 0.2::DOUBLE, 2), 2) ELSE 0 END, 9)"),
    "vox_cubic_spline": (lambda v: r(vx.cubic_spline(v * 8), 9), "round(CASE WHEN abs(v * 8) < 1 THEN 2 / 3.0::DOUBLE + (abs(v * 8) / 2 - 1) * abs(v * 8) * abs(v * 8) WHEN abs(v * 8) < 2 THEN -pow(abs(v * 8) - 2, 3) / 6 ELSE 0 END, 9)"),
    "vox_cubic_spline_slope": (lambda v: r(vx.cubic_spline_slope(v * 8), 9), "round(sign(v) * CASE WHEN abs(v * 8) < 1 THEN (1.5::DOUBLE * abs(v * 8) - 2) * abs(v * 8) WHEN abs(v * 8) < 2 THEN -pow(abs(v * 8) - 2, 2) / 2 ELSE 0 END, 9)"),
}
for _name, (_column, _sql) in UNARY.items():
    query(_name, f"SELECT t, i, ({_sql}) + 0 AS v FROM vox")(lambda d, s, p, v, c=_column: d.select("t", "i", c(v).alias("v")))

#: Beside each voxel that of the first image, w, in one pass over the voxels.
PAIRED = "WITH p AS MATERIALIZED (SELECT *, max(CASE WHEN t = 0 THEN v END) OVER (PARTITION BY i) AS w FROM vox) "

for _op, _sql in {"add": "v + w", "sub": "v - w", "mul": "v * w", "div": "CASE WHEN w <> 0 THEN v / w END", "min": "least(v, w)"}.items():
    query(f"vox_{_op}_image", PAIRED + f"SELECT t, i, ({_sql}) + 0 AS v FROM p")(lambda d, s, p, v, op=_op: d.join(d.where("t = 0").select("i", F.col("v").alias("w")), "i").select("t", "i", vx.combine(op, v, F.col("w")).alias("v")))


def first(d: DataFrame) -> DataFrame:
    return d.where("t = 0").select("i", "v")


def coarse(d: DataFrame, scale: float = 20.0) -> DataFrame:
    """Whole-number voxels, for exact counts and sums."""
    return d.withColumn("v", F.round(F.col("v") * scale))


COARSE = "WITH q AS (SELECT t, label, i, x, y, z, round(v * 20) AS v FROM vox) "

query("vox_masknan", PAIRED + "SELECT t, i, CASE WHEN w > 0 THEN v ELSE 0 END + 0 AS v, NOT (w > 0) AS missing FROM p")(lambda d, s, p, v: d.join(first(d).withColumnRenamed("v", "m"), "i").withColumn("v", vx.mask_nan(v, F.col("m"))).select("t", "i", F.nanvl(v, F.lit(0.0)).alias("v"), F.isnan(v).alias("missing")))
query("vox_zscore", "SELECT t, i, round((v - avg(v) OVER (PARTITION BY t)) / stddev_pop(v) OVER (PARTITION BY t), 6) AS v FROM vox")(lambda d, s, p, v: stats.z_scored(d).select("t", "i", r(v).alias("v")))


@query("vox_robust_z", "WITH o AS (SELECT t, max(CASE WHEN k = round(0.1::DOUBLE * 63) THEN v END) lo, max(CASE WHEN k = round(0.9::DOUBLE * 63) THEN v END) hi FROM (SELECT t, v, row_number() OVER (PARTITION BY t ORDER BY v) - 1 k FROM vox) GROUP BY t), m AS (SELECT x.t, avg(v) m, stddev_pop(v) s FROM vox x JOIN o ON x.t = o.t WHERE v > lo AND v < hi GROUP BY x.t) SELECT y.t, i, round((v - m) / s, 6) + 0 AS v FROM vox y JOIN m ON y.t = m.t")
def _robust_z(d, s, p, v):
    return stats.robust_z_scored(d, 0.1).select("t", "i", r(v).alias("v"))


query("vox_rescale", "SELECT t, i, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 255, 6) AS v FROM vox WINDOW w AS (PARTITION BY t)")(lambda d, s, p, v: d.withColumns({"lo": F.min("v").over(Window.partitionBy("t")), "hi": F.max("v").over(Window.partitionBy("t"))}).select("t", "i", r(vx.rescale(v, F.col("lo"), F.col("hi"), 0.0, 255.0)).alias("v")))
query("vox_sharpen")(lambda d, s, p, v: stencil.sharpen(d, 1.0).select("t", "i", r(v).alias("v")))
query("vox_normalized_array", "SELECT vec_id, round(abs(embedding[1]) / list_sum(list_transform(embedding, lambda e: abs(e)::DOUBLE)), 6) AS p FROM embeddings", raw=True)(lambda d, s, p, v: s.read.parquet(f"{p}/embeddings.parquet").select("vec_id", r(vx.normalized(F.transform("embedding", lambda e: F.abs(e).cast("double")))[0]).alias("p")))
query("vox_first_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding))::INT AS place FROM embeddings", raw=True)(lambda d, s, p, v: s.read.parquet(f"{p}/embeddings.parquet").select("vec_id", vx.first_argmax(F.col("embedding")).alias("place")))
query("vox_mixed_gaussian")(lambda d, s, p, v: d.select("t", "i", r(vx.mixed_gaussian(v, -0.1, 0.1, 0.01, 0.02)).alias("v")))
query("vox_rician_factor")(lambda d, s, p, v: d.select("t", "i", r(vx.rician_factor(F.abs(v) * 10), 6).alias("v")))


@query("vox_partial_volume", "WITH q AS (SELECT t, i, v, (i % 5 + 1) AS l, greatest(0, least(1, (v + 0.1::DOUBLE) / 0.1::DOUBLE)) a, greatest(0, least(1, v / 0.1::DOUBLE)) b FROM vox) SELECT t, i, round(CASE l WHEN 1 THEN 1 WHEN 2 THEN 1 - a ELSE 0 END, 6) AS first, round(CASE l WHEN 3 THEN 1 WHEN 2 THEN a WHEN 4 THEN 1 - b ELSE 0 END, 6) AS second, round(CASE l WHEN 5 THEN 1 WHEN 4 THEN b ELSE 0 END, 6) AS third FROM q")
def _pve(d, s, p, v):
    a, b, c = vx.partial_volume(v, F.col("i") % 5 + 1, -0.1, 0.0, 0.1)
    return d.select("t", "i", r(a).alias("first"), r(b).alias("second"), r(c).alias("third"))


# --- masks and statistics

query("masked_voxels", PAIRED + "SELECT t, i, v FROM p WHERE w > 0")(lambda d, s, p, v: stats.masked(d, first(d)).select("t", "i", "v"))
query("stat_summary", "SELECT t, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, count(*) AS n, count(*) FILTER (v > 0) AS n_positive, round(sum(v), 6) AS total FROM vox GROUP BY t")(lambda d, s, p, v: stats.summary(d).select("t", r("mean").alias("mean"), r("std").alias("std"), "min", "max", "n", "n_positive", r("total").alias("total")))
query("stat_masked_mean", "SELECT a.t, round(avg(a.v), 6) AS mean, count(*) AS n FROM vox a JOIN vox b ON a.i = b.i AND b.t = 0 WHERE b.v > 0 AND a.v > 0.02::DOUBLE GROUP BY a.t")(lambda d, s, p, v: stats.summary(stats.masked(d, first(d)).where("v > 0.02")).select("t", r("mean").alias("mean"), "n"))
query("stat_volume", "SELECT t, count(*) FILTER (v > 0) * 1.5::DOUBLE AS volume, round(sum(v) * 1.5::DOUBLE, 6) AS soft_volume FROM vox GROUP BY t")(lambda d, s, p, v: stats.summary(d, voxel_size=1.5).select("t", "volume", r("soft_volume").alias("soft_volume")))
query("stat_percentile", "SELECT t, max(CASE WHEN k = floor(0.3::DOUBLE * 63) THEN v END) AS percentile FROM (SELECT t, v, row_number() OVER (PARTITION BY t ORDER BY v) - 1 k FROM vox) GROUP BY t")(lambda d, s, p, v: stats.percentile(d, 30.0))
query("stat_robust_range", "SELECT t, max(CASE WHEN k = round(0.02::DOUBLE * 63) THEN v END) AS low, max(CASE WHEN k = round(0.98::DOUBLE * 63) THEN v END) AS high FROM (SELECT t, v, row_number() OVER (PARTITION BY t ORDER BY v) - 1 k FROM vox) GROUP BY t")(lambda d, s, p, v: stats.robust_range(d))
query("stat_histogram_percentile")(lambda d, s, p, v: stats.histogram_percentile(d, 90.0, 1000).select("t", r("percentile").alias("percentile")))
query("label_volumes", COARSE + ", c AS (SELECT t, v::INT AS value, count(*) n FROM q WHERE v >= 0 GROUP BY ALL), m AS (SELECT t, max(value) top FROM c GROUP BY t), e AS (SELECT t, unnest(range(0, top + 1))::INT AS value FROM m) SELECT e.t, e.value, coalesce(c.n, 0)::BIGINT AS n FROM e LEFT JOIN c ON e.t = c.t AND e.value = c.value")(lambda d, s, p, v: stats.label_volumes(coarse(d)).select("t", "value", "n"))
query("part_label_volumes", "WITH c AS (SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1) SELECT k::INT AS value, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, (SELECT max(value) FROM c) + 1)) AS k) LEFT JOIN c ON k = value", raw=True)(lambda d, s, p, v: stats.label_volumes(s.read.parquet(f"{p}/part.parquet").select(F.lit(0).alias("t"), F.col("p_size").cast("double").alias("v"))).select("value", "n"))
query("label_means", "WITH c AS (SELECT label, round(avg(v), 6) AS mean, count(*) AS n FROM vox WHERE label >= 0 GROUP BY label) SELECT k::INT AS label, mean, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, (SELECT max(label) FROM c) + 1)) AS k) LEFT JOIN c ON k = label")(lambda d, s, p, v: stats.label_means(d.select(F.concat_ws("-", "t", "i").alias("i"), "v"), d.select(F.concat_ws("-", "t", "i").alias("i"), "label")).select("label", r("mean").alias("mean"), "n"))
_DICE = COARSE + ", a AS (SELECT t, i, greatest(v, 0)::INT l FROM q), b AS (SELECT t - 1 AS t, i, l FROM a), j AS (SELECT a.l AS l, b.l AS m FROM a JOIN b USING (t, i)), k AS (SELECT l AS label, 1 AS na, 0 AS nb, (l = m)::INT AS shared FROM j UNION ALL SELECT m, 0, 1, 0 FROM j) SELECT label, round(2 * sum(shared) / (sum(na) + sum(nb)), 9) AS dice, sum(shared)::BIGINT AS n_both FROM k GROUP BY label"


def _labels(d):
    a = coarse(d).select("t", "i", F.greatest(F.col("v"), F.lit(0.0)).cast("int").alias("label"))
    return a, a.withColumn("t", F.col("t") - 1)


query("dice_by_label", _DICE)(lambda d, s, p, v: stats.dice(*_labels(d)).select("label", r("dice", 9).alias("dice"), "n_both"))
query("dice_above", _DICE + " HAVING round(2 * sum(shared) / (sum(na) + sum(nb)), 9) > 0.2")(lambda d, s, p, v: stats.dice(*_labels(d), at_least=0.2).select("label", r("dice", 9).alias("dice"), "n_both"))
query("label_agreement", "SELECT quality AS label, toxic AS other, count(*) AS n FROM labels GROUP BY ALL", raw=True)(lambda d, s, p, v: stats.confusion(s.read.parquet(f"{p}/labels.parquet").select("doc_id", F.col("quality").alias("label")), s.read.parquet(f"{p}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))))
query("stat_entropy", "WITH m AS (SELECT *, v / max(v) OVER (PARTITION BY t) p FROM vox) SELECT t, round(sum(CASE WHEN v > 0 THEN -p * ln(p) END), 6) AS entropy, round(sum(CASE WHEN v > 0 THEN -p * ln(p) END) / count(*), 6) AS normed FROM m GROUP BY t")(lambda d, s, p, v: stats.entropy(d).select("t", r("entropy").alias("entropy"), r("normed").alias("normed")))
query("stat_bbox", "SELECT t, min(x) AS xmin, max(x) - min(x) AS xsize, min(y) AS ymin, max(y) - min(y) AS ysize, min(z) AS zmin, max(z) - min(z) AS zsize FROM vox WHERE v > 0.15::DOUBLE GROUP BY t")(lambda d, s, p, v: stats.bounding_box(d.withColumn("v", v - 0.15).where("v > 0")))
query("stat_centroid", "SELECT t, round(sum(x * v) / sum(v), 6) AS cx, round(sum(y * v) / sum(v), 6) AS cy, round(sum(z * v) / sum(v), 6) AS cz FROM vox WHERE v > 0 GROUP BY t")(lambda d, s, p, v: stats.centroid(d).select("t", *[r(f"c{a}").alias(f"c{a}") for a in "xyz"]))
for _name, _big in (("stat_argmax", True), ("stat_argmin", False)):
    query(_name, f"SELECT t, x, y, z, v FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v {'DESC' if _big else ''}, i) k FROM vox) WHERE k = 1")(lambda d, s, p, v, big=_big: stats.extreme_place(d, big))
query("slice_stats", "SELECT t, z, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) FILTER (v > 0)::DOUBLE AS volume FROM vox GROUP BY t, z")(lambda d, s, p, v: stats.slices(d, "z").select("t", "z", r("mean").alias("mean"), r("std").alias("std"), F.col("volume").cast("double").alias("volume")))
query("slice_mean_image", "SELECT t, i, round(avg(v) OVER (PARTITION BY t, y), 6) AS v FROM vox")(lambda d, s, p, v: stats.slice_image(d, "y").select("t", "i", r(v).alias("v")))
query("over_time", "SELECT i, round(avg(v), 6) AS tmean, max(v) AS tmax, min(v) AS tmin, round(stddev_samp(v), 6) AS tstd FROM vox GROUP BY i")(lambda d, s, p, v: stats.over_time(d).select("i", r("tmean").alias("tmean"), "tmax", "tmin", r("tstd").alias("tstd")))
query("tpmax", "SELECT i, t AS tpmax FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, t) k FROM vox) WHERE k = 1")(lambda d, s, p, v: stats.over_time(d).select("i", "tpmax"))
query("image_z_scores", "WITH m AS (SELECT i, avg(v) m, stddev_samp(v) s FROM vox GROUP BY i) SELECT t, round(avg((v - m) * (v - m) / s), 6) AS z_score FROM vox JOIN m USING (i) WHERE s > 0 GROUP BY t")(lambda d, s, p, v: stats.z_scores(d).select("t", r("z_score").alias("z_score")))
query("histogram", "WITH m AS (SELECT *, min(v) OVER w lo, max(v) OVER w hi FROM vox WINDOW w AS (PARTITION BY t)) SELECT t, least(15, floor((v - lo) / (hi - lo) * 16))::INT AS bin, count(*) AS n FROM m GROUP BY ALL")(lambda d, s, p, v: stats.histogram(d, 16).select("t", "bin", "n"))
query("otsu")(lambda d, s, p, v: stats.otsu(d, 32).select("t", "bin", r("between").alias("between")))
query("ncc_topk", "SELECT b.t, round(covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v) + 1e-7), 6) AS ncc FROM vox a JOIN vox b ON a.i = b.i WHERE a.t = 0 GROUP BY b.t ORDER BY covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v) + 1e-7) DESC, b.t LIMIT 10")(lambda d, s, p, v: ranking.top_ncc(d, first(d), 10).select("t", r("ncc").alias("ncc")))
query("roi_ncc_topk", "SELECT b.t, round(covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v) + 1e-7), 6) AS ncc FROM vox a JOIN vox b ON a.i = b.i WHERE a.t = 0 AND a.i < 32 GROUP BY b.t ORDER BY covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v) + 1e-7) DESC, b.t LIMIT 10")(lambda d, s, p, v: ranking.roi_ncc(d, first(d), d.where("t = 0 and i < 32").select("i"), 10).select("t", r("ncc").alias("ncc")))
query("ssd_log", "SELECT b.t, round(ln(sum((a.v - b.v) * (a.v - b.v)) + 1), 6) AS ssd FROM vox a JOIN vox b ON a.i = b.i WHERE a.t = 0 GROUP BY b.t")(lambda d, s, p, v: stats.ssd(d, first(d)).select("t", r("ssd").alias("ssd")))
query("joint_entropies")(lambda d, s, p, v: stats.joint_entropies(d.withColumn("v", F.floor(v * 16 + 8)), first(d).withColumn("v", F.floor(v * 16 + 8)), 16).select("t", *[r(c).alias(c) for c in ("h_a", "h_b", "h_joint", "nmi")]))
query("mean_rms", "WITH l AS (SELECT t // 3 AS t, i, sqrt(sum(v * v)) l FROM vox GROUP BY ALL) SELECT t, round(avg(l), 6) AS mean_rms, round(max(l), 6) AS max_length FROM l GROUP BY t")(lambda d, s, p, v: stats.mean_rms(d.select(F.expr("t div 3").alias("t"), (F.col("t") % 3).alias("u"), "i", "v")).select("t", r("mean_rms").alias("mean_rms"), r("max_length").alias("max_length")))
query("line_fit", "SELECT b.t, round(regr_slope(a.v, b.v), 6) AS slope, round(regr_intercept(a.v, b.v), 6) AS intercept FROM vox a JOIN vox b ON a.i = b.i WHERE a.t = 0 GROUP BY b.t")(lambda d, s, p, v: stats.line_fit(d, first(d)).select("t", r("slope").alias("slope"), r("intercept").alias("intercept")))
query("line_normalized", PAIRED + ", f AS (SELECT t, regr_slope(w, v) s, regr_intercept(w, v) c FROM p GROUP BY t) SELECT p.t, i, round(s * v + c, 6) + 0 AS v FROM p JOIN f ON p.t = f.t")(lambda d, s, p, v: stats.line_normalized(d, first(d)).select("t", "i", r(v).alias("v")))
query("trimmed_line_fit")(lambda d, s, p, v: stats.trimmed_line_fit(d, first(d)).select("t", r("slope").alias("slope"), r("intercept").alias("intercept")))
query("polynomial_normalized")(lambda d, s, p, v: stats.polynomial_normalized(d, first(d), 2).select("t", "i", r(v).alias("v")))
query("quantile_matched")(lambda d, s, p, v: stats.quantile_matched(d, first(d), 32).select("t", "i", r(v).alias("v")))

# --- reshaping

query("merge", "SELECT 0 AS t, i, v FROM vox WHERE t = 3 UNION ALL SELECT 1, i, v FROM vox WHERE t = 5")(lambda d, s, p, v: reshape.merge([d.where("t = 3").select("t", "i", "v"), d.where("t = 5").select("t", "i", "v")]))
query("select_plane", "SELECT i, v FROM vox WHERE t = 4")(lambda d, s, p, v: reshape.select_plane(d, 4).select("i", "v"))
query("split_labels", COARSE + ", l AS (SELECT unnest(range(0, max(v)::INT + 1))::INT AS label FROM q) SELECT t, i, l.label, CASE WHEN v = l.label THEN 1.0::DOUBLE ELSE 0 END AS v FROM q, l")(lambda d, s, p, v: reshape.split_labels(coarse(d).drop("label")).select("t", "i", "label", "v"))
query("split_interleaved", "SELECT t, x % 2 AS part, x // 2 AS x, y, z, v FROM vox")(lambda d, s, p, v: reshape.split_interleaved(d, "x").select("t", "part", "x", "y", "z", "v"))
query("join_interleaved", "SELECT t, x, y, z, v FROM vox")(lambda d, s, p, v: reshape.join_interleaved(reshape.split_interleaved(d, "z"), "z").select("t", "x", "y", "z", "v"))
query("crop", "SELECT t, x - 1 AS x, y - 1 AS y, z - 1 AS z, (x - 1) + 2 * ((y - 1) + 2 * (z - 1)) AS i, v FROM vox WHERE x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 2 AND z BETWEEN 1 AND 2")(lambda d, s, p, v: reshape.crop(d, 1, 4, 4, 4).select("t", "x", "y", "z", "i", "v"))
query("pad", "WITH b AS (SELECT DISTINCT t FROM vox) SELECT b.t, g.x::INT AS x, h.y::INT AS y, k.z::INT AS z, coalesce(v, 0) AS v, v IS NULL AS border FROM b, generate_series(0, 5) g(x), generate_series(0, 5) h(y), generate_series(0, 5) k(z) LEFT JOIN vox ON vox.t = b.t AND vox.x = g.x - 1 AND vox.y = h.y - 1 AND vox.z = k.z - 1")(lambda d, s, p, v: reshape.pad(d, 1, 4, 4, 4).select("t", "x", "y", "z", F.nanvl(v, F.lit(0.0)).alias("v"), F.isnan(v).alias("border")))
query("subsample_xy", "SELECT t, x // 2 AS x, y // 2 AS y, z, v FROM vox WHERE x % 2 = 0 AND y % 2 = 0")(lambda d, s, p, v: reshape.subsample(d, "xy").select("t", "x", "y", "z", "v"))
query("subsample_smooth")(lambda d, s, p, v: reshape.subsample(stencil.gaussian(d, 0.5)).select("t", "x", "y", "z", r(v).alias("v")))
query("flip", "SELECT t, 3 - x AS x, y, z, v FROM vox")(lambda d, s, p, v: reshape.flip(d, "x", 4).select("t", "x", "y", "z", "v"))
query("swap_time", "SELECT (t // 10)::BIGINT AS u, (t % 10)::BIGINT AS t, i, v FROM vox")(lambda d, s, p, v: reshape.swap_time_and_component(d.select((F.col("t") % 10).alias("u"), F.expr("t div 10").alias("_t"), "i", "v").withColumnRenamed("_t", "t")).select("u", "t", "i", "v"))
query("relabel", COARSE + "SELECT t, i, CASE v WHEN 1 THEN 9.0::DOUBLE WHEN 2 THEN 8.0::DOUBLE ELSE v END + 0 AS v FROM q")(lambda d, s, p, v: reshape.relabel(coarse(d), {1: 9, 2: 8}).select("t", "i", "v"))
query("mask_intersect", "SELECT t, i FROM vox WHERE v > 0 INTERSECT SELECT t, i FROM vox WHERE v < 0.1::DOUBLE")(lambda d, s, p, v: reshape.intersect(d, d.withColumn("v", 0.1 - v)))
query("mask_difference", "SELECT t, i FROM vox WHERE v > 0 EXCEPT SELECT t, i FROM vox WHERE v > 0.1::DOUBLE")(lambda d, s, p, v: reshape.difference(d, d.withColumn("v", v - 0.1)))

# --- neighbourhoods


def _box(f: str, k: int = 1) -> str:
    frame = lambda a: f"(PARTITION BY t, {', '.join(x for x in 'xyz' if x != a)} ORDER BY {a} RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    return f"WITH a AS (SELECT t, i, x, y, z, {f}(v) OVER {frame('x')} v FROM vox), b AS (SELECT t, i, x, y, z, {f}(v) OVER {frame('y')} v FROM a) SELECT t, i, {{}} AS v FROM (SELECT t, i, {f}(v) OVER {frame('z')} v FROM b)"


query("dilate_box", _box("max").format("v"))(lambda d, s, p, v: stencil.dilate(stencil.together(d), 1).select("t", "i", "v"))
query("erode_box", _box("min").format("v"))(lambda d, s, p, v: stencil.erode(stencil.together(d), 1).select("t", "i", "v"))
query("box_mean", _box("avg").format("round(v, 6)"))(lambda d, s, p, v: stencil.box_mean(stencil.together(d), 1).select("t", "i", r(v).alias("v")))
query("close_box")(lambda d, s, p, v: stencil.close(stencil.together(d), 1).select("t", "i", "v"))
query("open_box")(lambda d, s, p, v: stencil.open_(stencil.together(d), 1).select("t", "i", "v"))
query("gauss_separable")(lambda d, s, p, v: stencil.gaussian(stencil.together(d), 1.0).select("t", "i", r(v).alias("v")))
query("fwhm_smooth")(lambda d, s, p, v: stencil.fwhm_smooth(stencil.together(d), 3.0).select("t", "i", r(v).alias("v")))
_NEAR = "JOIN vox b ON a.t = b.t AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1"
query("count_erode", f"WITH m AS (SELECT t, max(v) top FROM vox GROUP BY t) SELECT a.t, a.i, CASE WHEN sum((b.v > 0.5::DOUBLE * top)::INT) = 27 THEN 1.0::DOUBLE ELSE 0 END AS v FROM vox a {_NEAR} JOIN m ON m.t = a.t GROUP BY a.t, a.i")(lambda d, s, p, v: stencil.count_erode(d).select("t", "i", "v"))
query("count_dilate", f"WITH m AS (SELECT t, max(v) top FROM vox GROUP BY t) SELECT a.t, a.i, CASE WHEN sum((b.v > 0.5::DOUBLE * top)::INT) >= 1 THEN 1.0::DOUBLE ELSE 0 END AS v FROM vox a {_NEAR} JOIN m ON m.t = a.t GROUP BY a.t, a.i")(lambda d, s, p, v: stencil.count_dilate(d).select("t", "i", "v"))
query("local_moments", f"SELECT a.t, a.i, round(avg(b.v), 6) AS mean, round(var_samp(b.v), 6) AS var FROM vox a {_NEAR} GROUP BY a.t, a.i")(lambda d, s, p, v: stencil.local_moments(d).select("t", "i", r("mean").alias("mean"), r("var").alias("var")))
query("median3", f"SELECT t, i, list_sort(w)[((len(w) - 1) // 2 + 1)::INT] AS v FROM (SELECT a.t, a.i, list(b.v) w FROM vox a {_NEAR} GROUP BY a.t, a.i)")(lambda d, s, p, v: stencil.median3(d).select("t", "i", "v"))
query("label_smooth")(lambda d, s, p, v: stencil.label_smooth(coarse(d), 1.0).select("t", "i", "v"))
query("edge")(lambda d, s, p, v: stencil.edge(d, 0.5).select("t", "i", "v"))
query("gradient", "SELECT t, i, round(gx, 6) AS gx, round(sqrt(gx * gx + gy * gy + gz * gz), 6) AS mag FROM (SELECT t, i, " + ", ".join(f"(coalesce(lead(v) OVER w{a}, v) - coalesce(lag(v) OVER w{a}, v)) / (CASE WHEN lag(v) OVER w{a} IS NULL OR lead(v) OVER w{a} IS NULL THEN 1 ELSE 2 END) g{a}" for a in "xyz") + " FROM vox WINDOW " + ", ".join(f"w{a} AS (PARTITION BY t, {', '.join(b for b in 'xyz' if b != a)} ORDER BY {a})" for a in "xyz") + ")")(lambda d, s, p, v: stencil.gradient(d).select("t", "i", r("gx").alias("gx"), r("mag").alias("mag")))
query("sobel3")(lambda d, s, p, v: stencil.sobel(stencil.together(d), 3).select("t", "i", r(v).alias("v")))
query("sobel5")(lambda d, s, p, v: stencil.sobel(stencil.together(d), 5).select("t", "i", r(v).alias("v")))
query("local_ncc_rank")(lambda d, s, p, v: ranking.top_each_voxel(stencil.local_ncc(d, first(d), 1.0).where("t > 0").withColumn("lncc", r("lncc")), "lncc", 3).select("i", "t", "rank", "lncc"))
query("local_ssd")(lambda d, s, p, v: stencil.local_ssd(d, first(d), 1.0).select("t", "i", r(v).alias("v")))
query("diffuse")(lambda d, s, p, v: stencil.diffuse(stencil.together(d), 0.3, 2).select("t", "i", r(v).alias("v")))
query("laplace")(lambda d, s, p, v: stencil.laplace(stencil.together(d).withColumn("free", F.col("i") % 3 > 0), 3).select("t", "i", r(v).alias("v")))
query("split_norm")(lambda d, s, p, v: stencil.split_norm(d, "z").select("t", "i", r(v).alias("v")))
query("chain", "SELECT t, i, CASE WHEN abs(v * 2) > 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END AS v FROM vox")(lambda d, s, p, v: compile_chain(["-mul", "2", "-abs", "-thr", "0.1", "-bin"])(d).select("t", "i", "v"))

# --- ranking, fusion, clustering


def _votes(d: DataFrame) -> DataFrame:
    return d.select("i", F.col("t").alias("rater"), F.least(F.lit(2), F.greatest(F.lit(0), F.round(F.col("v") * 8 + 1))).cast("int").alias("label"))


_VOTES = "WITH r AS (SELECT i, t AS rater, least(2, greatest(0, round(v * 8 + 1)))::INT AS label FROM vox) "
query("majority_vote", _VOTES + ", c AS (SELECT i, label, count(*) n FROM r GROUP BY ALL) SELECT i, label, n FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, label) k FROM c) WHERE k = 1")(lambda d, s, p, v: ranking.majority(_votes(d)).select("i", "label", "n"))
query("uncertain_voxels", _VOTES + ", c AS (SELECT i, label, count(*) n FROM r GROUP BY ALL) SELECT i FROM c GROUP BY i HAVING max(n) < ceil(sum(n) * 0.7::DOUBLE)")(lambda d, s, p, v: ranking.uncertain(_votes(d), 0.7))
query("staple")(lambda d, s, p, v: ranking.staple(_votes(d), 3)[0].select("i", "label", r("p").alias("p")))
query("shape_average")(lambda d, s, p, v: ranking.shape_average(components.signed_distance(d.withColumn("v", (v > 0).cast("double"))).select("i", F.col("t").alias("rater"), F.explode(F.array(F.struct(F.lit(0).alias("label"), (-F.col("d")).alias("d")), F.struct(F.lit(1).alias("label"), F.col("d").alias("d")))).alias("_s")).select("i", "rater", "_s.label", "_s.d")))
query("block_variances", "SELECT t, bx, \"by\", bz, round(var, 6) AS var FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY var DESC, bz, \"by\", bx) k, count(*) OVER (PARTITION BY t) c FROM (SELECT t, (x // 2) AS bx, (y // 2) AS \"by\", (z // 2) AS bz, var_pop(v) var FROM vox GROUP BY ALL)) WHERE k <= ceil(c * 0.5)")(lambda d, s, p, v: ranking.block_variances(d, 2, 0.5).select("t", "bx", "by", "bz", r("var").alias("var")))
query("kmeans")(lambda d, s, p, v: cluster.kmeans(d.withColumn("v", F.abs(v)), 3)[0].select("t", "i", "label"))
query("class_means")(lambda d, s, p, v: cluster.class_means(cluster.kmeans(d.withColumn("v", F.abs(v)), 3)[0]).select("label", r("mean").alias("mean"), "n"))
query("neighbour_counts")(lambda d, s, p, v: cluster.neighbour_counts(d.withColumn("label", (F.col("i") * 7 + F.col("t")) % 3 + 1), 3))
query("gaussian_mixture")(lambda d, s, p, v: cluster.mixture(d, 2)[0].select("t", "i", r(F.col("p")[0]).alias("p")))
query("mean_field")(lambda d, s, p, v: cluster.mean_field(cluster.mixture(d, 2)[0], 2, 0.4).select("t", "i", r(F.col("p")[0]).alias("p")))
query("icm_labels")(lambda d, s, p, v: cluster.icm(cluster.mixture(d, 2)[0].withColumn("label", F.when(F.col("p")[0] >= 0.5, 1).otherwise(2)), 2, 0.1).select("t", "i", "label"))
query("block_moments", "WITH k AS (SELECT t, (i % 2 + 1)::INT AS label, v, unnest(list_distinct([x // 2, (x + 1) // 2]))::INT nx, y, z FROM vox), l AS (SELECT t, label, v, nx, unnest(list_distinct([y // 2, (y + 1) // 2]))::INT ny, z FROM k), m AS (SELECT t, label, v, nx, ny, unnest(list_distinct([z // 2, (z + 1) // 2]))::INT nz FROM l) SELECT t, nx, ny, nz, label, round(avg(v), 6) AS mean, count(*) AS n FROM m GROUP BY ALL HAVING count(*) > 6")(lambda d, s, p, v: cluster.block_moments(d.withColumn("label", F.col("i") % 2 + 1), 2).select("t", "nx", "ny", "nz", "label", r("mean").alias("mean"), "n"))
query("local_map_labels")(lambda d, s, p, v: cluster.local_map_labels(d.withColumn("label", F.when(v > 0, 2).otherwise(1)), 2, 2).select("t", "i", "label"))

# --- components, distances, warps

_CC = """WITH RECURSIVE vox AS MATERIALIZED (SELECT vec_id t, (u - 1)::INT i, ((u - 1) % 4)::INT x, (((u - 1) // 4) % 4)::INT y, ((u - 1) // 16)::INT z, embedding[u]::DOUBLE v FROM embeddings, generate_series(1, 64) g(u)),
s AS MATERIALIZED (SELECT * FROM vox WHERE v > 0.05::DOUBLE), e AS MATERIALIZED (SELECT a.t, a.i AS a, b.i AS b FROM s a JOIN s b ON a.t = b.t AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
c(t, i, component) AS (SELECT t, i, i FROM s UNION SELECT e.t, e.b, c.component FROM c JOIN e ON e.t = c.t AND e.a = c.i) SELECT t, i, min(component) AS component FROM c GROUP BY t, i"""
query("components", _CC, raw=True)(lambda d, s, p, v: components.components(d.where("v > 0.05"), 6).select("t", "i", "component"))
query("components_26")(lambda d, s, p, v: components.sized_components(d.where("v > 0.1"), 26))
query("largest_component")(lambda d, s, p, v: components.largest_component(d.where("v > 0.05"), 6).select("t", "i"))
query("fill_holes")(lambda d, s, p, v: components.fill_holes(d, 4, 4, 4).select("t", "i", "v"))
query("distance")(lambda d, s, p, v: components.distance(d.withColumn("v", v - 0.2)).select("t", "i", r("d").alias("d"), "seed"))
query("geodesic")(lambda d, s, p, v: components.geodesic(d.withColumn("v", v - 0.2).withColumn("speed", F.abs(v) + 0.5)).select("t", "i", r("time").alias("time")))
_TURN = [[0.9, 0.1, 0.0, 0.2], [-0.1, 0.9, 0.0, 0.3], [0.0, 0.0, 1.0, 0.5], [0.0, 0.0, 0.0, 1.0]]
query("affine_field", "SELECT t, i, round(0.9::DOUBLE * x + 0.1::DOUBLE * y + 0.2::DOUBLE, 6) + 0 AS px, round(-0.1::DOUBLE * x + 0.9::DOUBLE * y + 0.3::DOUBLE, 6) + 0 AS py, round(z + 0.5::DOUBLE, 6) AS pz FROM vox")(lambda d, s, p, v: registration.affine_field(d, _TURN).select("t", "i", r("px").alias("px"), r("py").alias("py"), r("pz").alias("pz")))
query("resample_nearest", "WITH p AS (SELECT t, i, floor(0.9::DOUBLE * x + 0.1::DOUBLE * y + 0.2::DOUBLE + 0.5)::INT x, floor(-0.1::DOUBLE * x + 0.9::DOUBLE * y + 0.3::DOUBLE + 0.5)::INT y, floor(z + 0.5::DOUBLE + 0.5)::INT z FROM vox) SELECT p.t, p.i, coalesce(vox.v, 0) AS v FROM p LEFT JOIN vox ON p.t = vox.t AND p.x = vox.x AND p.y = vox.y AND p.z = vox.z")(lambda d, s, p, v: registration.resample(registration.affine_field(d, _TURN), d, False))
query("resample_linear")(lambda d, s, p, v: registration.resample(registration.affine_field(d, _TURN), d).select("t", "i", r(v).alias("v")))
_TAPS = ", ".join(f"floor(p{a})::INT + k{a}.k AS {a}, CASE k{a}.k WHEN -1 THEN f{a} * ((2 - f{a}) * f{a} - 1) WHEN 0 THEN f{a} * f{a} * (3 * f{a} - 5) + 2 WHEN 1 THEN f{a} * ((4 - 3 * f{a}) * f{a} + 1) ELSE (f{a} - 1) * f{a} * f{a} END / 2 AS w{a}" for a in "xyz")
query("resample_cubic", "WITH f AS (SELECT t, i, 0.9::DOUBLE * x + 0.1::DOUBLE * y + 0.2::DOUBLE AS px, -0.1::DOUBLE * x + 0.9::DOUBLE * y + 0.3::DOUBLE AS py, z + 0.5::DOUBLE AS pz FROM vox), g AS (SELECT *, " + ", ".join(f"p{a} - floor(p{a}) AS f{a}" for a in "xyz") + " FROM f), h AS (SELECT t, i, " + _TAPS + " FROM g, " + ", ".join(f"generate_series(-1, 2) k{a}(k)" for a in "xyz") + ") SELECT h.t, h.i, round(sum(wx * wy * wz * coalesce(v, 0)), 6) + 0 AS v FROM h LEFT JOIN vox ON vox.t = h.t AND vox.x = h.x AND vox.y = h.y AND vox.z = h.z GROUP BY h.t, h.i")(lambda d, s, p, v: registration.resample_cubic(registration.affine_field(d, _TURN), d).select("t", "i", r(v).alias("v")))
query("jacobian")(lambda d, s, p, v: registration.jacobian(registration.affine_field(d, _TURN)).select("t", "i", r("jacobian").alias("jacobian")))
query("block_match")(lambda d, s, p, v: registration.block_match(d, d.withColumn("x", F.col("x") + 1), 2, 1).select("t", "bx", "by", "bz", "dx", "dy", "dz"))
query("exponentiate")(lambda d, s, p, v: registration.exponentiate(d.withColumns({"ux": v * 0.1, "uy": F.lit(0.05), "uz": F.lit(0.0)}), 2).select("t", "i", *[r(f"p{a}").alias(f"p{a}") for a in "xyz"]))
query("non_local_means")(lambda d, s, p, v: kernels.per_stack(d, (4, 4, 4), kernels.non_local_means(0.2)).select("t", "i", r(v).alias("v")))


def _watershed(d, s, p, v):
    import numpy as np

    markers = np.zeros((4, 4, 4))
    markers[0, 0, 0], markers[3, 3, 3] = 1, 2
    return kernels.per_volume(d, (4, 4, 4), kernels.watershed(markers))


query("watershed")(_watershed)


def _patch_fill(d, s, p, v):
    import numpy as np

    mask = np.zeros((4, 4, 4), bool)
    mask[1:3, 1:3, 1:3] = True
    return kernels.per_stack(d, (4, 4, 4), kernels.patch_fill(mask)).select("t", "i", r(v).alias("v"))


query("patch_fill")(_patch_fill)


def _march(d, s, p, v):
    import numpy as np

    return kernels.per_volume(d.withColumn("v", v - 0.2), (4, 4, 4), kernels.fast_marching(np.ones((4, 4, 4)))).where("v < 1e30").select("t", "i", r(v).alias("v"))


query("fast_marching")(_march)

query("bias_field")(lambda d, s, p, v: bias.bias_field(d, (4, 4, 4), 2).select("t", "i", r("bias").alias("bias")))
query("relaxed_prior")(lambda d, s, p, v: bias.relaxed_prior(stencil.gaussian(stencil.together(d), 1.0), d, 0.3).select("t", "i", r(v).alias("v")))
query("nmi")(lambda d, s, p, v: bias.smoothed_nmi(d.withColumn("v", v * 60 + 34), first(d).withColumn("v", v * 60 + 34)).select("t", r("nmi").alias("nmi")))
query("patch_matches")(lambda d, s, p, v: patches.patch_matches(d.where("t = 0"), d.where("t <> 0"), 3))
query("patch_labels")(lambda d, s, p, v: patches.fuse_labels(patches.patch_matches(d.where("t = 0"), d.where("t <> 0"), 3), d.select("t", "x", "y", "z", (v > 0).cast("int").alias("label"))))
query("masked_polynomial")(lambda d, s, p, v: stats.polynomial_normalized(stats.masked(d, first(d)), first(d), 2).select("t", "i", r(v).alias("v")))
query("em_segment")(lambda d, s, p, v: segmentation.segment(d, 2, beta=0.3, bias_order=1, shape=(4, 4, 4), outliers=3.0, rounds=5).select("t", "i", "label", r(F.col("p")[0]).alias("p"), r("bias").alias("bias")))
query("prior_strength")(lambda d, s, p, v: s.createDataFrame([(k, round(x, 6)) for k, x in sorted(cluster.mrf_strength(d.withColumn("label", (F.col("i") * 7 + F.col("t")) % 3 + 1), 3)[0].items())], "label int, share double"))
query("spline_field")(lambda d, s, p, v: registration.spline_field(d, s.range(216).select((F.col("id") % 6 - 1).cast("int").alias("cx"), (F.expr("id div 6") % 6 - 1).cast("int").alias("cy"), (F.expr("id div 36") - 1).cast("int").alias("cz")).withColumns({"ux": F.col("cx") * 2.0, "uy": F.col("cy") * 2.0, "uz": F.col("cz") * 2.0 + 1}), 2).select("t", "i", *[r(f"p{a}").alias(f"p{a}") for a in "xyz"]))
query("bending_energy")(lambda d, s, p, v: registration.bending_energy(d.select("t", *[F.col(a).alias(f"c{a}") for a in "xyz"], v.alias("ux"), (v * v).alias("uy"), F.lit(0.0).alias("uz"))).select("t", r("bending_energy").alias("bending_energy")))
query("affine_fit")(lambda d, s, p, v: s.createDataFrame([(k, *map(float, (row + 0.0).round(6))) for k, row in enumerate(registration.affine_fit(registration.affine_field(d, _TURN).select(*[F.col(a).cast("double").alias(f"p{a}") for a in "xyz"], *[F.col(f"p{a}").alias(f"q{a}") for a in "xyz"])))], "row int, x double, y double, z double, w double"))
_BALL = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1"
query("close_by_distance", f"WITH m AS (SELECT t, max(v) AS top FROM vox GROUP BY t), s AS MATERIALIZED (SELECT vox.t, x, y, z FROM vox JOIN m ON m.t = vox.t WHERE v > 0.5::DOUBLE * top), l AS MATERIALIZED (SELECT t, g.x::INT AS x, h.y::INT AS y, k.z::INT AS z FROM m, generate_series(-1, 4) g(x), generate_series(-1, 4) h(y), generate_series(-1, 4) k(z)), o AS MATERIALIZED (SELECT * FROM l a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.t = b.t AND {_BALL})) SELECT a.t, a.i, CASE WHEN EXISTS (SELECT 1 FROM o b WHERE a.t = b.t AND {_BALL}) THEN 0.0::DOUBLE ELSE 1 END AS v FROM vox a")(lambda d, s, p, v: components.close_by_distance(d, 1, 4, 4, 4).select("t", "i", "v"))
query("open_by_distance", f"WITH m AS (SELECT t, max(v) AS top FROM vox GROUP BY t), s AS MATERIALIZED (SELECT vox.t, x, y, z FROM vox JOIN m ON m.t = vox.t WHERE v <= 0.1::DOUBLE * top), o AS MATERIALIZED (SELECT t, x, y, z FROM vox a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.t = b.t AND {_BALL})) SELECT a.t, a.i, CASE WHEN EXISTS (SELECT 1 FROM o b WHERE a.t = b.t AND {_BALL}) THEN 1.0::DOUBLE ELSE 0 END AS v FROM vox a")(lambda d, s, p, v: components.open_by_distance(d, 1, 0.1).select("t", "i", "v"))
query("components_18")(lambda d, s, p, v: components.sized_components(d.where("v > 0.1"), 18))

# --- the same operators on the other tables

query("lineitem_slice_means", "SELECT l_linenumber AS x, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1", raw=True)(lambda d, s, p, v: stats.summary(s.read.parquet(f"{p}/lineitem.parquet").select(F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("v")), ["x"]).select("x", r("mean").alias("mean"), "n"))
query("lineitem_label_volumes", "SELECT l_returnflag AS label, sum(l_quantity) AS total, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1", raw=True)(lambda d, s, p, v: stats.summary(s.read.parquet(f"{p}/lineitem.parquet").select(F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("v")), ["label"]).select("label", "total", "min", "max"))
query("orders_label_means", "SELECT o_orderstatus AS label, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY 1", raw=True)(lambda d, s, p, v: stats.summary(s.read.parquet(f"{p}/orders.parquet").select(F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("v")), ["label"]).select("label", r("mean", 4).alias("mean"), r("std", 4).alias("std")))
query("customer_z_scores", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment)) / stddev_pop(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS z FROM customer", raw=True)(lambda d, s, p, v: s.read.parquet(f"{p}/customer.parquet").select("c_custkey", r((F.col("c_acctbal") - F.avg("c_acctbal").over(Window.partitionBy("c_mktsegment"))) / F.stddev_pop("c_acctbal").over(Window.partitionBy("c_mktsegment"))).alias("z")))
query("supplier_nation_means", "SELECT n_name, round(avg(s_acctbal), 6) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", raw=True)(lambda d, s, p, v: s.read.parquet(f"{p}/supplier.parquet").join(s.read.parquet(f"{p}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(r(F.avg("s_acctbal")).alias("mean")))
query("event_signal_mean", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS v FROM events", raw=True)(lambda d, s, p, v: s.read.parquet(f"{p}/events.parquet").select("user_id", "event_id", r(F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-1, 1))).alias("v")))

from gridloom.plans import lattice_queries, oracle_texts  # noqa: E402, F401  the first adds queries of its own

ORACLE_SQL |= {name: VOX + (", " + text[5:] if text.startswith("WITH ") else text) for name, text in oracle_texts.TEXTS.items()}
