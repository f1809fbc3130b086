"""Folds and hold-outs that depend on keys and a seed only, never on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.columns import draw

from .matching import drop_twins

#: Ranges of the draw in which folds are dealt; their counts are the only rows ranked together.
N_RANGES = 4096


def kfold_assign(members: DataFrame, k: int, seed: int) -> DataFrame:
    """(member, fold 0..k-1): shuffled, the first n % k folds one larger.

    Members are ranked inside ranges of their draw; the counts of the ranges, of which there are
    N_RANGES at most, give each range its first rank.
    """
    rows = members.select("member").distinct().withColumn("u", draw(F.col("member"), 0, seed)).withColumn("range", F.floor(F.col("u") * N_RANGES))
    counts = rows.groupBy("range").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n"))
    i = F.col("first") + F.row_number().over(Window.partitionBy("range").orderBy("u", "member")) - 1
    small = F.floor(F.col("n") / k)
    large = (F.col("n") % k) * (small + 1)
    fold = F.when(F.col("i") < large, F.floor(F.col("i") / (small + 1))).otherwise(F.col("n") % k + F.floor((F.col("i") - large) / F.greatest(small, F.lit(1))))
    return rows.join(F.broadcast(counts), "range").withColumn("i", i).select("member", fold.cast("int").alias("fold"))


def kfold_train_test(folds: DataFrame, k: int) -> DataFrame:
    """(k, member, role)."""
    rows = folds.select("member", "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    return rows.select("k", "member", F.when(F.col("fold") == F.col("k"), "test").otherwise("train").alias("role"))


def holdout_top_level(levels: DataFrame, top: int, k: int, seed: int, fold: int, strict: bool = False) -> DataFrame:
    """(level, member, role) with only the top level split; strict removes lower members at held-out points.

    levels: (level, member, x).
    """
    folds = kfold_assign(levels.where(F.col("level") == top), k, seed)
    role = F.when((F.col("level") == top) & (F.col("fold") == fold), "test").otherwise("train")
    rows = levels.join(folds, "member", "left").select("level", "member", "x", role.alias("role"))
    if strict:
        held = rows.where("role = 'test'").select("member", "x")
        lower = rows.where(F.col("level") != top)
        rows = rows.where(F.col("level") == top).unionByName(drop_twins(lower, held).select(rows.columns))
    return rows.drop("x")


def select_by_name(names: DataFrame, tag: str, name: str = "name") -> DataFrame:
    return names.where(F.col(name).contains(tag))


def month_split_interleaved(field: DataFrame, ts: str = "ts") -> DataFrame:
    """half A holds odd months, half B even ones."""
    return field.withColumn("half", F.when(F.month(ts) % 2 == 1, "A").otherwise("B"))
