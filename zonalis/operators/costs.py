"""Costs of candidates: four terms under one aggregation, and the penalties.

Rows are (cand_id, [snapshot,] variable, block, mean, var, obs). Each cost is a weighted mean of
its term within a block, then sums weighted by variable, block and snapshot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_absolute() -> Column:
    return F.abs(F.col("mean") - F.col("obs"))


def term_squared() -> Column:
    return (F.col("mean") - F.col("obs")) ** 2


def _variance(floor: float) -> Column:
    return F.greatest("var", F.lit(floor))


def term_gaussian(floor: float = 1e-6, kappa: float = 0.0) -> Column:
    d, v = F.col("mean") - F.col("obs"), _variance(floor)
    return 0.5 * d * d / v + 0.5 * F.log(2 * math.pi * v) + kappa * v


def term_laplace(floor: float = 1e-6, kappa: float = 0.0) -> Column:
    d, v = F.col("mean") - F.col("obs"), _variance(floor)
    return math.sqrt(2) * F.abs(d) / F.sqrt(v) + 0.5 * F.log(2 * v) + kappa * v


def term_student_t(dof: float, floor: float = 1e-6, kappa: float = 0.0) -> Column:
    if dof <= 0:
        raise ValueError("degrees of freedom must be positive")
    d, v = F.col("mean") - F.col("obs"), _variance(floor)
    const = -math.lgamma((dof + 1) / 2) + math.lgamma(dof / 2) + 0.5 * math.log(dof * math.pi)
    return 0.5 * F.log(v) + 0.5 * (dof + 1) * F.log1p(d * d / (dof * v)) + const + kappa * v


def block_weights(w_var: dict, w_block: dict[str, float], override: dict | None = None) -> Column:
    """Weight of a variable times that of its block; override gives single variables other block weights."""
    unknown = sorted(set(override or ()) - set(w_var))
    if unknown:
        raise ValueError(f"block weights for unknown variables: {unknown}")
    out = F.lit(0.0)
    for v, w in reversed(list(w_var.items())):
        blocks = {**w_block, **(override or {}).get(v, {})}
        value = F.lit(0.0)
        for b, x in reversed(list(blocks.items())):
            value = F.when(F.col("block") == b, float(x) * float(w)).otherwise(value)
        out = F.when(F.col("variable") == v, value).otherwise(out)
    return out


def block_terms(rows: DataFrame, term: Column, keys: list[str], weight: Column | None = None, root: bool = False) -> DataFrame:
    """(keys, variable, block, term): weighted mean of the term within each block; root takes its square root."""
    w = F.lit(1.0) if weight is None else weight
    mean = F.try_divide(F.sum(w * term), F.sum(F.when(term.isNotNull(), w)))
    return rows.groupBy(*keys, "variable", "block").agg((F.sqrt(mean) if root else mean).alias("term"))


def cost(rows: DataFrame, term: Column, w_var: dict, w_block: dict[str, float], w_snap: dict | None = None,
         weight: Column | None = None, override: dict | None = None, root: bool = False) -> DataFrame:
    """(cand_id, cost)."""
    keys = ["cand_id", *(["snapshot"] if w_snap else [])]
    total = F.col("term") * block_weights(w_var, w_block, override)
    if w_snap:
        snap = F.lit(0.0)
        for s, w in w_snap.items():
            snap = F.when(F.col("snapshot") == s, float(w)).otherwise(snap)
        total = total * snap
    return block_terms(rows, term, keys, weight, root).groupBy("cand_id").agg(F.sum(total).alias("cost"))


def cost_mae_physical(rows: DataFrame, w_var: dict, w_block: dict[str, float], doubled_zonal: bool = False) -> DataFrame:
    """Absolute error in physical units, missing values skipped; doubled_zonal applies the zonal weight twice, as an older code did."""
    blocks = dict(w_block)
    if doubled_zonal:
        blocks["zonal"] = blocks["zonal"] ** 2
    return cost(rows, term_absolute(), w_var, blocks)


def layout_faults(rows: DataFrame, n_rows: int) -> DataFrame:
    """(cand_id, n) of the candidates that do not have exactly n_rows rows."""
    return rows.groupBy("cand_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != n_rows)


def layout_check(rows: DataFrame, n_rows: int) -> None:
    """Every candidate must have exactly n_rows rows."""
    bad = [r["cand_id"] for r in layout_faults(rows, n_rows).limit(10).collect()]
    if bad:
        raise ValueError(f"candidates without {n_rows} rows: {bad}")


def extra_variance(scaler: DataFrame, model_error: dict | None, obs_error: dict | None) -> DataFrame:
    """(variable, feat_idx, extra) in normalised units, from variances by variable and block.

    scaler: (variable, feat_idx, block, scale). A spec maps variable to {block: sigma}. Model errors are in
    normalised units unless the key is '<block>_phys'; observation errors are in physical units under either
    key. Both forms of one block, or unknown keys, are errors; None adds nothing.
    """
    blocks = [r["block"] for r in scaler.select("block").distinct().collect()]
    known = {r["variable"] for r in scaler.select("variable").distinct().collect()}
    extra = F.lit(0.0)
    for spec, physical in ((model_error, False), (obs_error, True)):
        for v, parts in (spec or {}).items():
            allowed = {*blocks, *(f"{b}_phys" for b in blocks)}
            if v not in known or set(parts) - allowed or any(b in parts and f"{b}_phys" in parts for b in blocks):
                raise ValueError(f"bad variance specification for {v}: {sorted(parts)}")
            for key, sigma in parts.items():
                block = key.removesuffix("_phys")
                s = F.lit(float(sigma)) / (F.col("scale") if physical or key != block else F.lit(1.0))
                extra = extra + F.when((F.col("variable") == v) & (F.col("block") == block), s * s).otherwise(0.0)
    return scaler.select("variable", "feat_idx", extra.alias("extra"))


def coverage_threshold(self_distances: DataFrame) -> DataFrame:
    """The largest distance from a training point to its nearest other one."""
    return self_distances.agg(F.max("dist").alias("threshold"))


def distance_penalty(distances: DataFrame, threshold: float, lam: float) -> DataFrame:
    return distances.select("id", (F.greatest(F.col("dist") - float(threshold), F.lit(0.0)) * float(lam)).alias("penalty"))


def cost_total(likelihood: DataFrame, penalty: DataFrame, constraint: DataFrame) -> DataFrame:
    """(cand_id, cost): the constraint's cost where one is violated, else likelihood plus penalty."""
    rows = likelihood.join(penalty.withColumnRenamed("id", "cand_id"), "cand_id", "left").join(constraint, "cand_id", "left")
    return rows.select("cand_id", F.coalesce("violation", F.col("cost") + F.coalesce("penalty", F.lit(0.0))).alias("cost"))


def cost_breakdown(rows: DataFrame, term: Column, w_var: dict, w_block: dict[str, float]) -> DataFrame:
    """Contribution of each variable and block, with subtotals of variables and the total (NULL keys)."""
    parts = block_terms(rows, term, ["cand_id"]).withColumn("part", F.col("term") * block_weights(w_var, w_block))
    return parts.rollup("cand_id", "variable", "block").agg(F.sum("part").alias("part")).where("cand_id is not null")


def cost_profiled_rss(rows: DataFrame) -> DataFrame:
    """(cand_id, cost): sum over blocks of N/2 * ln(RSS), the likelihood with sigma profiled out."""
    each = rows.groupBy("cand_id", "variable", "block").agg(F.count("mean").alias("n"), F.sum(term_squared()).alias("rss"))
    return each.groupBy("cand_id").agg(F.sum(F.col("n") / 2.0 * F.log("rss")).alias("cost"))
