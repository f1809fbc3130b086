"""Scaling of parameters and outputs, and the search box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.columns import rescale


def fit_minmax(params: DataFrame, flags: DataFrame | None = None, check: bool = True) -> DataFrame:
    """(param, lo, hi, is_log): declared bounds where given, else the data's range, in logs for flagged parameters.

    flags: (param, is_log, lo, hi) with NULL bounds where none are declared.
    """
    found = params.groupBy("param").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    if flags is None:
        flags = found.select("param", F.lit(False).alias("is_log"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    s = found.join(flags, "param", "left").select("param", F.coalesce("lo", "mn").alias("lo"), F.coalesce("hi", "mx").alias("hi"), F.coalesce("is_log", F.lit(False)).alias("is_log"))
    if check:
        bad = [r["param"] for r in s.where("is_log and (lo <= 0 or hi <= 0)").limit(10).collect()]
        if bad:
            raise ValueError(f"logarithmic parameters with a bound that is not positive: {bad}")
    return s.select("param", F.when(F.col("is_log"), F.log("lo")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("is_log"), F.log("hi")).otherwise(F.col("hi")).alias("hi"), "is_log")


def apply_minmax(params: DataFrame, scaler: DataFrame) -> DataFrame:
    z = F.when(F.col("is_log"), F.log(F.greatest("value", F.lit(1e-300)))).otherwise(F.col("value"))
    return params.join(F.broadcast(scaler), "param").withColumn("value", rescale(z, F.col("lo"), F.col("hi"))).drop("lo", "hi", "is_log")


def invert_minmax(params: DataFrame, scaler: DataFrame) -> DataFrame:
    z = F.col("lo") + F.col("value") * F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return params.join(F.broadcast(scaler), "param").withColumn("value", F.when(F.col("is_log"), F.exp(z)).otherwise(z)).drop("lo", "hi", "is_log")


def log_mask_check(log_names: list[str], names: list[str]) -> list[bool]:
    """Which parameters are logarithmic, in the order of names; an unknown name is an error."""
    unknown = sorted(set(log_names) - set(names))
    if unknown:
        raise ValueError(f"unknown logarithmic parameters: {unknown}")
    return [n in set(log_names) for n in names]


def log_mask_offenders(declared: DataFrame, params: DataFrame) -> DataFrame:
    """(param, n): declared logarithmic parameters that no member has, and how often each was declared; null names count as unknown."""
    known = params.select("param").distinct()
    return declared.join(known, "param", "left_anti").groupBy("param").agg(F.count(F.lit(1)).alias("n"))


def fit_standard(y: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, scale): population standard deviation, 1 where it is 0."""
    sd = F.stddev_pop("value")
    return y.groupBy(*keys).agg(F.avg("value").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("scale"))


def apply_standard(y: DataFrame, scaler: DataFrame, keys: list[str]) -> DataFrame:
    return y.join(F.broadcast(scaler), keys).withColumn("value", (F.col("value") - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def invert_standard(y: DataFrame, scaler: DataFrame, keys: list[str], variance: str | None = None) -> DataFrame:
    """Back to physical units; a variance column scales by the square alone."""
    out = y.join(F.broadcast(scaler), keys).withColumn("value", F.col("value") * F.col("scale") + F.col("mean"))
    if variance:
        out = out.withColumn(variance, F.col(variance) * F.col("scale") * F.col("scale"))
    return out.drop("mean", "scale")


def sampled_range(params: DataFrame, declared: DataFrame) -> DataFrame:
    """(param, lo, hi, share): declared bounds cut to the sampled range, and the share of them that is left."""
    s = params.groupBy("param").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    s = declared.join(s, "param").withColumns({"l": F.greatest("lo", "mn"), "h": F.least("hi", "mx")})
    return s.select("param", F.col("l").alias("lo"), F.col("h").alias("hi"), F.try_divide(F.col("h") - F.col("l"), F.col("hi") - F.col("lo")).alias("share"))


def rescale_to_box(points: DataFrame, box: DataFrame) -> DataFrame:
    """Values and standard errors in units of each parameter's box; points: (param, value, stderr)."""
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return points.join(F.broadcast(box), "param").withColumns({"value": (F.col("value") - F.col("lo")) / span, "stderr": F.col("stderr") / span}).drop("lo", "hi")
