"""Joins between levels and runs: twins, duplicates, nearest points and nearest members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.columns import member_index, rescale

from .neighbours import nearest_neighbor as nearest_neighbor


def _apart(a: str, b: str) -> Column:
    """Largest absolute difference of two vectors."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def _grid_keys(x: str, tol: float) -> Column:
    """Keys under which vectors within tol meet: the first two elements in cells ten tolerances wide.

    Vectors at an edge get the neighbouring cell too, so that none is missed.
    """
    size = tol * 10
    near = [F.array_distinct(F.array(*(F.floor(F.get(x, F.lit(i)) / size + s) for s in (-0.15, 0.15)))) for i in (0, 1)]
    return F.flatten(F.transform(near[0], lambda a: F.transform(near[1], lambda b: F.xxhash64(a, b))))


def twin_match(low: DataFrame, high: DataFrame, tol: float = 1e-9) -> DataFrame:
    """(member_low, member_high): for each high member the nearest low one within tol in every parameter.

    low, high: (member, x). The cells of the first parameters are the join key, the full vectors decide.
    """
    a = low.select(F.col("member").alias("member_low"), F.col("x").alias("x_low"), F.explode(_grid_keys("x", tol)).alias("cell"))
    b = high.select(F.col("member").alias("member_high"), F.col("x").alias("x_high"), F.explode(_grid_keys("x", tol)).alias("cell"))
    both = a.join(b, "cell").withColumn("d", _apart("x_low", "x_high")).where(F.col("d") <= tol)
    return both.groupBy("member_high").agg(F.min_by("member_low", F.struct("d", "member_low")).alias("member_low")).select("member_low", "member_high")


def drop_twins(low: DataFrame, held: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Lower-level members that are at no held-out parameter point."""
    a = low.withColumn("cell", F.explode(_grid_keys("x", tol))).select(F.col("member").alias("m"), F.col("x").alias("x1"), "cell")
    b = held.select(F.col("x").alias("x2"), F.explode(_grid_keys("x", tol)).alias("cell"))
    gone = a.join(b, "cell").where(_apart("x1", "x2") <= tol).select(F.col("m").alias("member")).distinct()
    return low.join(gone, "member", "left_anti")


def dup_check(selected: DataFrame, training: DataFrame) -> DataFrame:
    """Selected members that are in the training set."""
    return selected.join(training.select("member"), "member", "left_semi")


def name_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of runs whose names hold the same member index."""
    x = a.select(member_index(F.col("name")).alias("idx"), F.col("name").alias("name_a"))
    y = b.select(member_index(F.col("name")).alias("idx"), F.col("name").alias("name_b"))
    return x.where("idx is not null").join(y, "idx")


def scaled_points(points: DataFrame, box: DataFrame) -> DataFrame:
    """(id, x) from (id, param, value) rows, each parameter rescaled to its box (param, lo, hi)."""
    rows = points.join(F.broadcast(box), "param").select("id", "param", rescale(F.col("value"), F.col("lo"), F.col("hi")).alias("u"))
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("param", "u"))), lambda s: s["u"]).alias("x"))


def nearest_member_field(field: DataFrame, run: DataFrame) -> DataFrame:
    """(variable, member, rmse): the ensemble member whose field is closest to a run's; variable 'all' sums over variables."""
    both = field.join(run.select("variable", "ncol", F.col("value").alias("ref")), ["variable", "ncol"])
    each = both.groupBy("member", "variable").agg(F.sqrt(F.avg((F.col("value") - F.col("ref")) ** 2)).alias("rmse"))
    every = each.groupBy("member").agg(F.sum("rmse").alias("rmse")).select("member", F.lit("all").alias("variable"), "rmse")
    both = each.select("member", "variable", "rmse").unionByName(every)
    return both.groupBy("variable").agg(F.min(F.struct("rmse", "member")).alias("m")).select("variable", "m.member", "m.rmse")


def levels_union(*levels: DataFrame) -> DataFrame:
    out = levels[0]
    for df in levels[1:]:
        out = out.unionByName(df)
    return out


def window_rank(df: DataFrame, order: list, keys: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based rank in a total order, over groups or all rows."""
    w = Window.partitionBy(*(keys or [])).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))
