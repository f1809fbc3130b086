"""Run comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.lineage import settled


def ranked(rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with rank, 1-based in a total order within each group of keys, and n, the group's size; no task holds a large group.

    Rows are dealt into ranges of (keys, order) and sorted there; a range's offset is the number of the group's rows in
    earlier ranges. Only one count for each group and range moves besides. Groups with null keys are groups like others.
    """
    taken = {c.lower() for c in rows.columns}
    part, at = (next(f"{c}{'_' * i}" for i in range(1, len(taken) + 2) if f"{c}{'_' * i}".lower() not in taken) for c in ("part", "at"))
    dealt = rows.repartitionByRange(ranges, *keys, *order) if ranges else rows.repartitionByRange(*keys, *order)
    dealt = dealt.sortWithinPartitions(*keys, *order).withColumn(at, F.monotonically_increasing_id())
    # The upper bits of these numbers are the partition's, the lower ones the row's place in it.
    dealt = settled(dealt.withColumn(part, F.shiftright(at, 33)))
    group = Window.partitionBy(*keys)
    counts = dealt.groupBy(*keys, part).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, part])), "_first", earlier.alias("_before"), F.sum("_n").over(group).alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, part])]
    out = dealt.join(counts, same).withColumn("rank", F.col("_before") + F.col(at) - F.col("_first") + 1)
    return out.select(*rows.columns, "rank", "n")


def closest_to_obs(rows: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """Ranks scenarios by |pred - obs| at each place and labels them; ties go to the first name, missing errors come last. rows: scenario, pred, obs."""
    out = rows.withColumn("error", F.abs(F.col("pred") - F.col("obs"))).withColumn("_none", F.col("error").isNull())
    out = ranked(out, keys, ["_none", "error", "scenario"], ranges).drop("_none").withColumn("rank", F.col("rank").cast("int"))
    return out.withColumn("label", F.when(F.col("rank") == 1, "closest").when(F.col("rank") == F.col("n"), "furthest").otherwise("middle")).drop("n")


def closest_counts(rows: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """(keys, scenario, n_closest): at how many places `of` each scenario is the closest; a minimum for each place, and no ranks."""
    error = F.abs(F.col("pred") - F.col("obs"))
    best = rows.groupBy(*keys, *of).agg(F.min(F.struct(error.isNull().alias("none"), error.alias("error"), "scenario")).alias("m"))
    won = best.groupBy(*keys, F.col("m.scenario").alias("scenario")).agg(F.count(F.lit(1)).alias("n_closest"))
    every = rows.select(*keys, "scenario").distinct()
    return every.join(won, [*keys, "scenario"], "left").select(*keys, "scenario", F.coalesce("n_closest", F.lit(0)).alias("n_closest"))


def error_extremes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Largest, smallest and mean |obs - pred| per scenario."""
    e = F.abs(F.col("obs") - F.col("pred"))
    return rows.groupBy(*keys, "scenario").agg(F.max(e).alias("most"), F.min(e).alias("least"), F.avg(e).alias("mean"))


def anomaly_to_default(zrg: DataFrame, default: DataFrame, keys: list[str]) -> DataFrame:
    d = default.select(*keys, F.col("value").alias("_d"))
    return zrg.join(d, keys).withColumn("anomaly", F.col("value") - F.col("_d")).drop("_d")


def param_comparison(points: DataFrame, runs: list[str], near: float = 1e-3) -> DataFrame:
    """Wide table: a row for each parameter, with value and at_bound for each run; points: (param, run, value in [0, 1], physical)."""
    rows = points.withColumn("at_bound", (F.col("value") <= near) | (F.col("value") >= 1 - near))
    return rows.groupBy("param").pivot("run", runs).agg(F.first("value").alias("value"), F.first("physical").alias("physical"), F.first("at_bound").alias("at_bound"))


def level_spread_compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distributions of two levels beside each other, and whether their ranges overlap; inputs from ensemble_spread."""
    x = a.select(*keys, *(F.col(c).alias(f"{c}_a") for c in ("n", "mean", "sd", "lo", "hi")))
    y = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in ("n", "mean", "sd", "lo", "hi")))
    return x.join(y, keys).withColumn("overlap", (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a")))


def calib_param_path(rounds: DataFrame, bounds: DataFrame, near: float = 1e-3) -> DataFrame:
    """(round, param, value, at_bound) over rounds (round, x array); bounds: (param, lo, hi)."""
    rows = rounds.select("round", F.posexplode("x").alias("param", "value")).join(F.broadcast(bounds), "param")
    edge = near * (F.col("hi") - F.col("lo"))
    return rows.select("round", "param", "value", ((F.col("value") - F.col("lo") <= edge) | (F.col("hi") - F.col("value") <= edge)).alias("at_bound"))
