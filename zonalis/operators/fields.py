"""Field preparation: derived variables, interpolation, time means, masks, remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.columns import month_days, weighted_mean


def derive_sum(field: DataFrame, components: list[str], name: str, keys: list[str]) -> DataFrame:
    """Sum of component variables; NULL unless all are there."""
    rows = field.where(F.col("variable").isin(*components)).groupBy(*keys)
    total = F.when(F.count("value") == len(components), F.sum("value"))
    return rows.agg(total.alias("value")).withColumn("variable", F.lit(name))


def derive_linear(field: DataFrame, coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """For each target, the sum of coeff times variable; NULL unless all inputs are there.

    coefficients: (target, variable, coeff), a few rows.
    """
    need = coefficients.groupBy("target").agg(F.count(F.lit(1)).alias("need"))
    c = F.broadcast(coefficients.join(need, "target"))
    rows = field.join(c, "variable").groupBy(*keys, "target").agg(
        F.sum(F.col("value") * F.col("coeff")).alias("s"), F.count("value").alias("have"), F.first("need").alias("need"))
    return rows.select(*keys, F.col("target").alias("variable"), F.when(F.col("have") == F.col("need"), F.col("s")).alias("value"))


def interp_plev(profile: DataFrame, keys: list[str], plev: float, pressure: str = "p", value: str = "value") -> DataFrame:
    """Value at one pressure, linear in log pressure; one row for each column.

    The level above must be strictly above plev and the next one at or below it; otherwise NULL.
    """
    w = Window.partitionBy(*keys).orderBy(pressure)
    p, f = F.col(pressure), F.col(value)
    below_p, below_f = F.lead(p).over(w), F.lead(f).over(w)
    rows = profile.withColumns({"_p2": below_p, "_f2": below_f})
    share = (F.log(F.lit(float(plev))) - F.log(p)) / (F.log("_p2") - F.log(p))
    at = F.when((p < plev) & (F.col("_p2") >= plev), f + (F.col("_f2") - f) * share)
    return rows.groupBy(*keys).agg(F.max(at).alias(value))


def month_weighted_mean(field: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Time mean weighted by days in the month; missing months leave both sums."""
    return field.groupBy(*keys).agg(weighted_mean(F.col(value), month_days(F.col(ts))).alias(value))


def month_window_select(field: DataFrame, first: str, last: str, ts: str = "ts", check: bool = False) -> DataFrame:
    """Rows of a window of months; with check, it must hold exactly twelve."""
    out = field.where(F.col(ts).between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))
    if check:
        n = out.select(F.date_trunc("month", ts)).distinct().count()
        if n != 12:
            raise ValueError(f"the window has {n} months, not 12")
    return out


def unit_scale(field: DataFrame, units: DataFrame) -> DataFrame:
    """Values times the factor of their variable; units: (variable, factor), 1 where absent."""
    out = field.join(F.broadcast(units), "variable", "left").withColumn("value", F.col("value") * F.coalesce("factor", F.lit(1.0)))
    return out.drop("factor")


def obs_mask(sim: DataFrame, obs: DataFrame, all_or_nothing: bool = True) -> DataFrame:
    """Blanks simulated cells without an observation.

    A snapshot is masked only if every one of its variables has observations; with
    all_or_nothing=False each variable with observations is.
    """
    have = obs.where("value is not null").select("snapshot", "variable").distinct().withColumn("have", F.lit(True))
    flags = sim.select("snapshot", "variable").distinct().join(have, ["snapshot", "variable"], "left")
    flags = flags.withColumn("have", F.coalesce("have", F.lit(False)))
    if all_or_nothing:
        flags = flags.withColumn("have", F.min("have").over(Window.partitionBy("snapshot")))
    o = obs.where("value is not null").select("snapshot", "variable", "ncol", F.lit(True).alias("seen"))
    out = sim.join(F.broadcast(flags), ["snapshot", "variable"]).join(o, ["snapshot", "variable", "ncol"], "left")
    return out.withColumn("value", F.when(F.col("have") & F.col("seen").isNull(), None).otherwise(F.col("value"))).drop("have", "seen")


def land_mask(field: DataFrame, land: DataFrame, least: float = 0.5) -> DataFrame:
    """Keeps values where the land fraction reaches the limit; land: (ncol, land)."""
    return field.join(land, "ncol", "left").withColumn("value", F.when(F.col("land") >= least, F.col("value"))).drop("land")


def below_ground_mask(field: DataFrame, surface_pressure: DataFrame, least: float) -> DataFrame:
    """Drops cells whose lowest annual-mean surface pressure over all levels is below the limit.

    surface_pressure: (level, ncol, ts, value), monthly.
    """
    annual = month_weighted_mean(surface_pressure, ["level", "ncol"])
    good = annual.groupBy("ncol").agg(F.min("value").alias("low")).where(F.col("low") >= least).select("ncol")
    return field.join(good, "ncol", "left_semi")


def regrid_sparse(field: DataFrame, weights: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Sparse remapping, renormalised by the weight that met valid cells; NULL where that is at most `least`.

    weights: (row, col, s). The product is a join and one aggregation, so neither side need fit anywhere.
    """
    met = F.sum(F.when(F.col("value").isNotNull(), F.col("s")))
    out = field.join(weights, field["ncol"] == weights["col"]).groupBy(*keys, "row").agg(F.sum(F.col("s") * F.col("value")).alias("v"), met.alias("met"))
    return out.select(*keys, F.col("row").alias("ncol"), F.when(F.col("met") > least, F.col("v") / F.col("met")).alias("value"))


def nearest_grid_sample(columns: DataFrame, raster: DataFrame, lat0: float, dlat: float, n_lat: int, dlon: float, n_lon: int) -> DataFrame:
    """Each column's value of a regular lat-lon raster: nearest lat, nearest lon modulo 360.

    raster: (i_lat, i_lon, value), with latitude lat0 + i * dlat and longitude i * dlon.
    """
    i = F.least(F.greatest(F.floor((F.col("lat") - lat0) / dlat + 0.5), F.lit(0)), F.lit(n_lat - 1)).cast("int")
    j = F.pmod(F.floor(F.col("lon") / dlon + 0.5).cast("int"), F.lit(n_lon))
    return columns.withColumns({"i_lat": i, "i_lon": j}).join(raster, ["i_lat", "i_lon"], "left")


def ordering_penalty(x: Column, pairs: list[tuple[int, int]]) -> Column:
    """100 + 100 * violation of the first pair (low, high) with x[low] > x[high]; NULL if none is violated."""
    each = [F.when(F.get(x, F.lit(i)) > F.get(x, F.lit(j)), 100.0 + 100.0 * (F.get(x, F.lit(i)) - F.get(x, F.lit(j)))) for i, j in pairs]
    return F.coalesce(*each, F.lit(None).cast("double"))


def expand_subset(candidates: DataFrame, frozen: DataFrame, names: str = "param") -> DataFrame:
    """Full vectors from candidates that vary only some parameters.

    candidates: (cand_id, param, value); frozen: (param, default, lo, hi), clipped to the sampled range.
    """
    ids = candidates.select("cand_id").distinct()
    full = ids.crossJoin(F.broadcast(frozen)).join(candidates, ["cand_id", names], "left")
    return full.select("cand_id", names, F.coalesce("value", F.least(F.greatest("default", "lo"), "hi")).alias("value"))
