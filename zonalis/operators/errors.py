"""Model-error calibration and observation-error estimates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.lineage import exists, round_state, settled


def sigma_moment(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """max(0, weighted mean of r² - v_gp - v_obs); residuals: r, gp_var, obs_var, w."""
    m = F.try_divide(F.sum(F.col("w") * (F.col("r") ** 2 - F.col("gp_var") - F.col("obs_var"))), F.sum("w"))
    return residuals.groupBy(*keys).agg(F.greatest(m, F.lit(0.0)).alias("s2"))


def nll_term(r: Column, v: Column, likelihood: str = "gaussian", dof: float = 4.0, kappa: float = 0.0) -> Column:
    """The cost's term as a function of residual and variance."""
    if likelihood == "gaussian":
        t = 0.5 * r * r / v + 0.5 * F.log(2 * math.pi * v)
    elif likelihood == "laplace":
        t = math.sqrt(2) * F.abs(r) / F.sqrt(v) + 0.5 * F.log(2 * v)
    elif likelihood != "student_t":
        raise ValueError(f"no likelihood {likelihood}")
    else:
        const = -math.lgamma((dof + 1) / 2) + math.lgamma(dof / 2) + 0.5 * math.log(dof * math.pi)
        t = 0.5 * F.log(v) + 0.5 * (dof + 1) * F.log1p(r * r / (dof * v)) + const
    return t + kappa * v


def nll_slope(r: Column, v: Column, likelihood: str = "gaussian", dof: float = 4.0, kappa: float = 0.0) -> Column:
    """Derivative of nll_term by the variance."""
    if likelihood == "gaussian":
        t = 0.5 / v - 0.5 * r * r / (v * v)
    elif likelihood == "laplace":
        t = 0.5 / v - math.sqrt(0.5) * F.abs(r) / (v * F.sqrt(v))
    else:
        t = 0.5 / v - 0.5 * (dof + 1) * r * r / (v * (dof * v + r * r))
    return t + kappa


#: Smallest positive variance that a search looks at, and the range of its first points above the largest squares; fixed values of the estimator.
LEAST_S2, ABOVE = 1e-8, 10.0


def sigma_mle(residuals: DataFrame, keys: list[str], points: int = 8, first: int = 24, tol: float = 1e-10, floor: float = 1e-6, passes: int = 30, **likelihood) -> DataFrame:
    """(keys, s2, nll, passes): the extra variance of least weighted mean NLL in each block.

    residuals: keys, r, gp_var, obs_var, w, stored once. A first pass takes the NLL at zero and at `first` points in geometric steps and
    keeps the neighbours of the best one. Each further pass takes the slope of the NLL at `points` values inside the
    interval of each block, all as sums of one aggregate, and goes on with the part in which it turns upward, until the
    interval is narrower than tol of its place or after `passes` passes in all. Intervals are a small table of one row
    for each block. Residuals with a null weight or value count for nothing; a block without any has no row.
    """
    rows = residuals.where("r is not null and gp_var is not null and obs_var is not null and w is not null")
    rows = settled(rows.select(*keys, "r", "w", (F.col("gp_var") + F.col("obs_var")).alias("_v")))
    top = rows.groupBy(*keys).agg(F.greatest(ABOVE * F.max(F.col("r") ** 2), ABOVE * F.max("_v"), F.lit(1e-3)).alias("_hi"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(first)), lambda i: F.when(i == 0, 0.0).otherwise(F.exp(math.log(LEAST_S2) + (F.log("_hi") - math.log(LEAST_S2)) * (i - 1) / (first - 1))))
    state = settled(top.select(*keys, grid.alias("_at")))

    def sums(n: int, term) -> list[Column]:
        """Weighted means of a term at the n values `at`, as f."""
        v = lambda i: F.greatest(F.col("_v") + F.get("_at", F.lit(i)), F.lit(floor))
        return [F.array(*(F.try_divide(F.sum(F.col("w") * term(F.col("r"), v(i), i)), F.sum("w")) for i in range(n))).alias("_f")]

    def value(r: Column, v: Column, i: int) -> Column:
        return nll_term(r, v, **likelihood)

    def slope(r: Column, v: Column, i: int) -> Column:
        # Below the floor the NLL does not change.
        return F.when(F.col("_v") + F.get("_at", F.lit(i)) < floor, 0.0).otherwise(nll_slope(r, v, **likelihood))

    def measured(state: DataFrame, terms: list[Column]) -> DataFrame:
        return state.join(rows.join(state.select(*keys, "_at"), keys).groupBy(*keys).agg(*terms), keys)

    best = (F.array_position("_f", F.array_min("_f")) - 1).cast("int")
    found = measured(state, sums(first + 1, value)).withColumn("_k", best).where("_k is not null")
    inside = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (points + 1)).alias("_at")
    state = found.select(*keys, F.get("_at", F.greatest(F.col("_k") - 1, F.lit(0))).alias("_lo"), F.get("_at", F.least(F.col("_k") + 1, F.lit(first))).alias("_hi"), F.lit(1).alias("passes"))
    state = round_state(state.select("*", inside))
    wide = (F.col("_hi") - F.col("_lo") > tol * F.greatest("_hi", F.lit(LEAST_S2))) & (F.col("passes") < passes - 1)
    # The first value from which the NLL rises; it falls before that.
    up = F.array_position(F.transform("_f", lambda g: g >= 0), F.lit(True)).cast("int")
    up = F.when(up > 0, up).otherwise(points + 1)
    ends = F.concat(F.array("_lo"), F.col("_at"), F.array("_hi"))
    closer = [*keys, F.when(wide, F.get(ends, up - 1)).otherwise(F.col("_lo")).alias("_lo"), F.when(wide, F.get(ends, up)).otherwise(F.col("_hi")).alias("_hi"), F.when(wide, F.col("passes") + 1).otherwise(F.col("passes")).alias("passes")]
    slopes = sums(points, slope)
    while not state.where(wide).isEmpty():
        state = round_state(measured(state, slopes).select(*closer).select("*", inside))
    # An interval that closed in on zero is zero; the last pass takes the NLL there.
    middle = (F.col("_lo") + F.col("_hi")) / 2
    at = F.when((F.col("_lo") == 0.0) & (F.col("_hi") <= 2 * LEAST_S2 * tol), 0.0).otherwise(middle)
    out = measured(state.withColumn("_at", F.array(at)), sums(1, value))
    return out.select(*keys, F.get("_at", F.lit(0)).alias("s2"), F.get("_f", F.lit(0)).alias("nll"), (F.col("passes") + 1).alias("passes"))


def sigma_grid(residuals: DataFrame, grid: DataFrame, keys: list[str], floor: float = 1e-6, **likelihood) -> DataFrame:
    """(keys, s2, nll) of the best point of a small grid (keys, s2): one pass over residuals times grid."""
    v = F.greatest(F.col("gp_var") + F.col("obs_var") + F.col("s2"), F.lit(floor))
    both = residuals.join(grid, keys)
    nll = both.groupBy(*keys, "s2").agg(F.try_divide(F.sum(F.col("w") * nll_term(F.col("r"), v, **likelihood)), F.sum("w")).alias("nll"))
    return nll.groupBy(*keys).agg(F.min(F.struct("nll", "s2")).alias("m")).select(*keys, "m.s2", "m.nll")


def residual_step(rows: DataFrame, keys: list[str], dof: float | None = None) -> DataFrame:
    """RMS residual, RMS sd and mean r²/V per block; V of Student-t scaled by dof / (dof - 2).

    rows: obs, mean, var, extra, and w where the locations of a block have weights; without, all count alike.
    """
    r, v = F.col("obs") - F.col("mean"), F.col("var") + F.col("extra")
    v = v * (dof / (dof - 2)) if dof else v
    w = F.col("w") if "w" in rows.columns else F.lit(1.0)

    def mean(x: Column) -> Column:
        return F.sum(w * x) / F.sum(F.when(x.isNotNull(), w))

    return rows.groupBy(*keys).agg(F.sqrt(mean(r * r)).alias("rms_residual"), F.sqrt(mean(F.col("var"))).alias("rms_sd"), mean(r * r / v).alias("chi2"))


def sigma_phys_equiv(sigmas: DataFrame, scaler: DataFrame, keys: list[str]) -> DataFrame:
    """Median over a block's features of sigma times scale."""
    return scaler.join(F.broadcast(sigmas), keys).groupBy(*keys).agg(F.median(F.col("sigma") * F.col("scale")).alias("sigma_phys"))


def calibrate_loop(optimise: Callable[[DataFrame], DataFrame], residuals: Callable[[DataFrame], DataFrame], keys: list[str], start: DataFrame, fixed: DataFrame | None = None,
                   method: str = "mle", tol_theta: float = 0.02, tol_sigma: float = 0.10, floor: float = 0.1, rounds: int = 4, path: str | None = None, **likelihood) -> DataFrame:
    """(round, keys, sigma_used, sigma_next, fixed, x, cost, dtheta, dsigma, converged): optimise, take residuals at the best point, re-estimate, until nothing moves.

    optimise maps sigmas (keys, sigma) to one row (..., x, cost), the best point; residuals maps that row to (keys, r,
    gp_var, obs_var, w). start: the first sigmas; fixed: sigmas (keys, sigma) that are used and never estimated. method:
    'mle' (likelihood and its parameters as for sigma_mle) or 'moment'. From the second round on, dtheta is the largest
    change of the best point and dsigma the largest of any sigma relative to max(|used|, floor), infinite if a block has
    come or gone; the loop has converged when both are below their tolerances.

    With path, each round is a folder of Parquet there, which counts once Spark has finished writing it; a loop that is
    called again goes on after the rounds that count, up to `rounds` in all, and one that has converged runs nothing.
    """
    spark = start.sparkSession
    same = [*keys, "sigma_next"]
    log: DataFrame | None = None
    sigma, last, done, n = start.select(*keys, F.col("sigma").cast("double").alias("sigma")), None, False, 0
    if fixed is not None:
        hold = fixed.select(*keys, F.col("sigma").cast("double").alias("sigma"))
        sigma = sigma.join(hold.select(*keys), keys, "left_anti").unionByName(hold)
    while path and n < rounds and exists(spark, f"{path}/round_{n}/_SUCCESS"):
        row = spark.read.parquet(f"{path}/round_{n}")
        log = row if log is None else log.unionByName(row)
        first = row.select("x", "converged").first()
        last, done, sigma, n = first["x"], first["converged"], row.select(*same).withColumnRenamed("sigma_next", "sigma"), n + 1
    while n < rounds and not done:
        used = settled(sigma)
        best = settled(optimise(used))
        top = best.select("x", "cost").first()
        if top is None:
            raise ValueError("no best point")
        rows = residuals(best)
        new = sigma_mle(rows, keys, **likelihood) if method == "mle" else sigma_moment(rows, keys)
        new = new.select(*keys, F.sqrt("s2").alias("sigma_next")).withColumn("fixed", F.lit(False))
        if fixed is not None:
            new = new.join(hold.select(*keys), keys, "left_anti").unionByName(hold.select(*keys, F.col("sigma").alias("sigma_next"), F.lit(True).alias("fixed")))
        both = settled(new.join(used.withColumnRenamed("sigma", "sigma_used"), keys, "full"))
        step = F.coalesce(F.abs(F.col("sigma_next") - F.col("sigma_used")) / F.greatest(F.abs("sigma_used"), F.lit(floor)), F.lit(float("inf")))
        dsigma = both.agg(F.max(step).alias("c")).first()["c"] if n else None
        dtheta = max((abs(a - b) for a, b in zip(top["x"], last, strict=True)), default=0.0) if n and last is not None else None
        done = dtheta is not None and dsigma is not None and dtheta < tol_theta and dsigma < tol_sigma
        # A block that has gone keeps no sigma.
        row = both.where("sigma_next is not null").select(F.lit(n).alias("round"), *keys, "sigma_used", "sigma_next", "fixed", F.array(*(F.lit(float(v)) for v in top["x"])).alias("x"), F.lit(top["cost"]).alias("cost"),
                                                          F.lit(dtheta).cast("double").alias("dtheta"), F.lit(dsigma).cast("double").alias("dsigma"), F.lit(done).alias("converged"))
        if path:
            row.write.mode("overwrite").parquet(f"{path}/round_{n}")
            row = spark.read.schema(row.schema).parquet(f"{path}/round_{n}")
        else:
            row = settled(row)
        log = row if log is None else log.unionByName(row)
        last, sigma, n = top["x"], row.select(*same).withColumnRenamed("sigma_next", "sigma"), n + 1
    if log is None:
        raise ValueError("no rounds asked for")
    return log


def calibrated_sigma(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sigma, fixed): those that the last round used if the loop has converged, else the newest ones."""
    last = log.agg(F.max("round").alias("round"))
    return log.join(F.broadcast(last), "round").select(*keys, F.when(F.col("converged"), F.col("sigma_used")).otherwise(F.col("sigma_next")).alias("sigma"), "fixed")


def sigma_sensitivity(optimise: Callable[[DataFrame], DataFrame], log: DataFrame, keys: list[str], factors: tuple[float, ...] = (0.5, 2.0)) -> DataFrame:
    """(factor, cost, dtheta_max, dtheta_rms): how far the best point moves when all sigmas that are not fixed are multiplied."""
    final = settled(calibrated_sigma(log, keys))
    base = log.join(F.broadcast(log.agg(F.max("round").alias("round"))), "round").select(F.col("x").alias("base")).limit(1)
    out = None
    for f in factors:
        best = optimise(final.select(*keys, F.when(F.col("fixed"), F.col("sigma")).otherwise(F.col("sigma") * f).alias("sigma")))
        d = F.zip_with("x", "base", lambda a, b: F.abs(a - b))
        row = best.select("x", "cost").crossJoin(base).select(F.lit(float(f)).alias("factor"), "cost", F.array_max(d).alias("dtheta_max"), F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v) / F.size("x")).alias("dtheta_rms"))
        out = row if out is None else out.unionByName(row)
    return out


def footprint_mean(daily: DataFrame, area: DataFrame, keys: list[str], n_times: int | None = None) -> DataFrame:
    """Area mean over cells that are valid at every time step; daily: (ncol, day, product, value)."""
    if n_times is None:
        every = daily.select("day").distinct().agg(F.count(F.lit(1)).alias("n"))
        good = daily.groupBy("product", "ncol").agg(F.count("value").alias("k")).join(F.broadcast(every), F.col("k") == F.col("n"), "left_semi")
    else:
        good = daily.groupBy("product", "ncol").agg(F.count("value").alias("k")).where(F.col("k") >= n_times)
    rows = daily.join(good.select("product", "ncol"), ["product", "ncol"], "left_semi").join(area, "ncol")
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col("value") * F.col("area")), F.sum(F.when(F.col("value").isNotNull(), F.col("area")))).alias("value"))


def error_propagation(errors: DataFrame, n_months: int = 12) -> DataFrame:
    """Global error if errors are fully correlated, and if independent; errors: (ncol, month, sigma, area)."""
    month = errors.groupBy("month").agg(F.try_divide(F.sum(F.col("area") * F.col("sigma")), F.sum("area")).alias("full"),
                                        F.try_divide(F.sqrt(F.sum((F.col("area") * F.col("sigma")) ** 2)), F.sum("area")).alias("ind"))
    return month.agg(F.avg("full").alias("correlated"), (F.sqrt(F.sum(F.col("ind") ** 2)) / n_months).alias("independent"))


def cos_lat_mean(field: DataFrame, keys: list[str]) -> DataFrame:
    w = F.cos(F.radians("lat"))
    return field.groupBy(*keys).agg(F.try_divide(F.sum(F.col("value") * w), F.sum(F.when(F.col("value").isNotNull(), w))).alias("value"))


def obs_error_fraction(spec: DataFrame, scaler: DataFrame) -> DataFrame:
    """An error as a fraction of the ensemble's spread; spec: (variable, error), scaler: (variable, mean, scale)."""
    return spec.join(F.broadcast(scaler), "variable").withColumn("fraction", F.try_divide("error", "scale"))
