"""Skill metrics, correlations and distribution statistics.

Truth and prediction are columns of one long table: (member, variable, feat_idx, truth, pred).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _sums(pairs: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """Per feature: squared error, and squares around the feature's mean."""
    t = F.col("truth")
    return pairs.groupBy(*keys, *of).agg(
        F.count(t).alias("n"), F.sum((t - F.col("pred")) ** 2).alias("sse"), (F.var_pop(t) * F.count(t)).alias("sst"))


def r2_variance_weighted(pairs: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """1 - sum of SSE / sum of SST over the features `of`, for each group of keys."""
    return _sums(pairs, keys, of).groupBy(*keys).agg((1.0 - F.try_divide(F.sum("sse"), F.sum("sst"))).alias("r2"))


def r2_per_feature(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return _sums(pairs, keys, []).select(*keys, (1.0 - F.try_divide("sse", "sst")).alias("r2"))


def r2_feature_summary(per_feature: DataFrame, keys: list[str]) -> DataFrame:
    return per_feature.groupBy(*keys).agg(F.avg("r2").alias("mean"), F.stddev_pop("r2").alias("sd"))


def r2_flat(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """All values of a group as one sample."""
    return r2_per_feature(pairs, keys)


def r2_uniform(pairs: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """Mean of the R² of each feature; with of=['member'], of each member."""
    return r2_per_feature(pairs, [*keys, *of]).groupBy(*keys).agg(F.avg("r2").alias("r2"))


def rmse_mean_of_columns(pairs: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """RMSE of each feature, averaged."""
    each = pairs.groupBy(*keys, *of).agg(F.sqrt(F.avg((F.col("truth") - F.col("pred")) ** 2)).alias("rmse"))
    return each.groupBy(*keys).agg(F.avg("rmse").alias("rmse"))


def rmse_pooled(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.sqrt(F.avg((F.col("truth") - F.col("pred")) ** 2)).alias("rmse"))


def area_weighted_error(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Signed, absolute and squared error over cells, weights normalised; pairs also has area."""
    d, w = F.col("pred") - F.col("truth"), F.col("area")
    total = F.sum(F.when(d.isNotNull(), w))
    return pairs.groupBy(*keys).agg(
        F.try_divide(F.sum(w * d), total).alias("bias"), F.try_divide(F.sum(w * F.abs(d)), total).alias("mae"), F.sqrt(F.try_divide(F.sum(w * d * d), total)).alias("rmse"))


def fold_summary(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(*(F.avg(n).alias(n) for n in names))


def zscore_coverage(pairs: DataFrame, keys: list[str], floor: float = 1e-12) -> DataFrame:
    """Mean squared residual in units of the predicted variance; pairs also has var."""
    return pairs.groupBy(*keys).agg(F.avg((F.col("truth") - F.col("pred")) ** 2 / F.greatest("var", F.lit(floor))).alias("z2"))


def baselines(predictors: dict[str, DataFrame], keys: list[str], of: list[str]) -> DataFrame:
    """R² and RMSE of several predictors on the same held-out points."""
    rows = None
    for name, df in predictors.items():
        df = df.withColumn("predictor", F.lit(name))
        rows = df if rows is None else rows.unionByName(df)
    k = ["predictor", *keys]
    return r2_variance_weighted(rows, k, of).join(rmse_mean_of_columns(rows, k, of), k)


def correlation(rows: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(keys, n, r) without groups that are too small or constant in x or y."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    n = F.count(a + b)
    # From sums around a member of the group: plain sums of squares would lose the digits of large means.
    stats = rows.groupBy(*keys).agg(n.alias("n"), F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"),
                                    (F.max(a) > F.min(a)).alias("va"), (F.max(b) > F.min(b)).alias("vb"))
    return stats.where(F.col("va") & F.col("vb") & (F.col("n") >= least)).select(*keys, "n", F.try_divide(F.col("c"), F.col("sa") * F.col("sb")).alias("r"))


def pearson_table(params: DataFrame, zrg: DataFrame, keys: list[str], p_values: bool = False) -> DataFrame:
    """(keys, param, feat_idx, variable, n, r[, p]) over members.

    A member's rows meet once; sums are kept for each (param, feature), so the product of
    parameters and features is aggregated before it moves.
    """
    both = zrg.join(params.select("member", "param", F.col("value").alias("x")), "member")
    out = correlation(both, [*keys, "param", "feat_idx", "variable"], "x", "value")
    if p_values:
        out = out.mapInPandas(_with_p, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", p double")
    return out


def _with_p(batches):
    for pdf in batches:
        yield pdf.assign(p=two_sided_p(pdf["r"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)))


def t_two_sided(r: float, n: int) -> float:
    """two_sided_p of one correlation."""
    return float(two_sided_p(np.array([r], dtype=float), np.array([n], dtype=float))[0])


def two_sided_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of correlations at n rows: I_{1-r²}((n-2)/2, 1/2); 1 without a degree of freedom, 0 at |r| = 1, NaN for NaN."""
    df = n - 2
    sure = np.abs(r) >= 1
    p = incomplete_beta(np.maximum(df, 1) / 2, np.full(len(r), 0.5), np.where(sure, 0.5, 1 - r * r))
    return np.where(np.isnan(r), np.nan, np.where(sure, 0.0, np.where(df <= 0, 1.0, p)))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of whole arrays, by its continued fraction."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (x > 0) & (x < 1)
    x = np.where(inside, x, 0.5)
    log_beta = np.vectorize(lambda u, v: math.lgamma(u + v) - math.lgamma(u) - math.lgamma(v), otypes=[float])(a, b)
    front = np.exp(a * np.log(x) + b * np.log1p(-x) + log_beta) / a
    # Modified Lentz evaluation of the fraction, until every row has settled.
    tiny = 1e-300
    whole = lambda v: np.where(v == 0, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / whole(1.0 - (a + b) * x / (a + 1))
    f = d.copy()
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / whole(1.0 + num * d), whole(1.0 + num / c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    out = np.where(inside, front * f, (x >= 1).astype(float))
    return np.where(flip, 1 - out, out)


def critical_correlations(sizes: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(n, r) for each different n >= 3 of sizes: the correlation that is significant there, by halving of all rows of a batch at once."""

    def run(batches):
        for pdf in batches:
            n = pdf["n"].to_numpy(dtype=float)
            lo, hi = np.zeros(len(n)), np.ones(len(n))
            for _ in range(60):
                mid = (lo + hi) / 2
                above = two_sided_p(mid, n) > alpha
                lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
            yield pd.DataFrame({"n": pdf["n"], "r": hi})

    return sizes.select(F.col("n").cast("int")).where("n >= 3").distinct().mapInPandas(run, "n int, r double")


def r_critical(spark: SparkSession, sizes: list[int], alpha: float = 0.05) -> DataFrame:
    """critical_correlations() of sizes that the caller holds."""
    return critical_correlations(spark.createDataFrame([(int(n),) for n in sizes], "n int"), alpha)


def top_k_params(table: DataFrame, k: int) -> DataFrame:
    """(param, score) of the k parameters with the largest maximum over variables of the mean |r|, in parameter order."""
    each = table.groupBy("param", "variable").agg(F.avg(F.abs("r")).alias("m")).groupBy("param").agg(F.max("m").alias("score"))
    return each.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "param"))).where(F.col("rank") <= k).drop("rank")


def sensitivity_diff(high: DataFrame, low: DataFrame) -> DataFrame:
    k = ["param", "feat_idx", "variable"]
    return high.select(*k, F.col("r").alias("r_high")).join(low.select(*k, F.col("r").alias("r_low")), k).withColumn("diff", F.col("r_high") - F.col("r_low"))


def slope_through_origin(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, slope, r): sum of xy over sum of x², and the correlation."""
    s = pairs.groupBy(*keys).agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) ** 2)).alias("slope"))
    return s.join(correlation(pairs, keys, x, y), keys, "left").select(*keys, "slope", "r")


def spread_ratio(high: DataFrame, low: DataFrame, keys: list[str]) -> DataFrame:
    a = high.groupBy(*keys).agg(F.stddev_pop("value").alias("sd_high"))
    b = low.groupBy(*keys).agg(F.stddev_pop("value").alias("sd_low"))
    return a.join(b, keys).withColumn("ratio", F.col("sd_high") / (F.col("sd_low") + 1e-30))


def resolution_bias(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Over twins: n, bias, percent of the reference mean, RMSD, r, and the least-squares line; pairs: ref, other."""
    x, y = F.col("ref"), F.col("other")
    s = pairs.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(y - x).alias("bias"), F.avg(x).alias("m"), F.sqrt(F.avg((y - x) ** 2)).alias("rmsd"),
                                 F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.avg(y).alias("my"))
    slope = F.try_divide("c", "vx")
    return s.select(*keys, "n", "bias", F.try_divide(100.0 * F.col("bias"), F.col("m")).alias("percent"), "rmsd",
                    F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))).alias("r"), slope.alias("slope"), (F.col("my") - slope * F.col("m")).alias("intercept"))


def linregress_regions(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return correlation(pairs, keys, "truth", "pred").select(*keys, (F.col("r") * F.col("r")).alias("r2"))


def structural_error(best: DataFrame, keys: list[str]) -> DataFrame:
    """RMS of observation minus optimum, and RMS of the surrogate's sd, by block; best: obs, mean, var."""
    return best.groupBy(*keys).agg(F.sqrt(F.avg((F.col("obs") - F.col("mean")) ** 2)).alias("rms_residual"), F.sqrt(F.avg("var")).alias("rms_sd"))
