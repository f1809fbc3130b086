"""The calibration tables, as views on the star-schema tables that the driver provides.

Each function gives one long table; CTES holds the same definition as SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = ("V1", "V2", "V3", "V4")
SNAPSHOTS = (1996, 1999)
N_PARAMS = 19
#: Block sizes of an output vector: zonal, regional, global.
N_ZONAL, N_REGIONAL, N_GLOBAL = 7, 3, 1
N_FEAT = N_ZONAL + N_REGIONAL + N_GLOBAL


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def run_name(before: str, number: str, digits: int) -> Column:
    """A run's name with at least so many digits of its number; lpad alone would cut longer numbers."""
    k = F.col(number).cast("string")
    return F.concat(F.lit(before), F.lpad(k, F.greatest(F.lit(digits), F.length(k)), F.lit("0")))


def grid(spark: SparkSession, d: str) -> DataFrame:
    """(ncol, lat, lon, area)."""
    k = F.col("p_partkey")
    return read(spark, d, "part").select(
        k.alias("ncol"), (((k * 37) % 1000 + 0.5) / 1000.0 * 180.0 - 90.0).alias("lat"), ((k * 53) % 360).cast("double").alias("lon"), F.col("p_size").cast("double").alias("area"))


def region_mask(spark: SparkSession, d: str) -> DataFrame:
    """(ncol, region), several rows for a cell in several regions."""
    names = F.array(F.col("p_type"), F.when(F.col("p_size") > 25, F.lit("OVERLAP")))
    return read(spark, d, "part").select(F.col("p_partkey").alias("ncol"), F.explode(F.array_compact(names)).alias("region"))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """(member, ncol, ts, snapshot, variable, value): one value for a member, cell, month and variable."""
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    rows = read(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("ncol"), F.date_trunc("month", "l_shipdate").alias("ts")).agg(
        F.avg(price).alias("V1"), F.avg("l_quantity").alias("V2"), F.avg(price * disc).alias("V3"), F.avg(price * (F.lit(1.0) - disc)).alias("V4"))
    return rows.withColumn("snapshot", F.year("ts")).unpivot(["member", "ncol", "ts", "snapshot"], list(VARIABLES), "variable", "value")


def field(spark: SparkSession, d: str) -> DataFrame:
    """(member, snapshot, variable, ncol, value): the months of the two snapshot years, weighted by their length."""
    from zonalis.operators.fields import month_weighted_mean

    rows = monthly(spark, d).where(F.col("snapshot").isin(*SNAPSHOTS))
    return month_weighted_mean(rows, ["member", "snapshot", "variable", "ncol"])


def obs_field(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot, variable, ncol, value): NULL where a cell was not observed; V4 of 1999 is absent."""
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    seen = read(spark, d, "lineitem").where(F.col("l_returnflag") == "R").groupBy(F.col("l_partkey").alias("ncol")).agg(
        F.avg(price).alias("V1"), F.avg("l_quantity").alias("V2"), F.avg(price * disc).alias("V3"), F.avg(price * (F.lit(1.0) - disc)).alias("V4"))
    seen = seen.unpivot(["ncol"], list(VARIABLES), "variable", "value")
    seen = seen.select("ncol", "variable", F.when(F.col("ncol") % 7 != 0, F.col("value")).alias("value"), F.explode(F.array(*map(F.lit, SNAPSHOTS))).alias("snapshot"))
    return seen.where(~((F.col("snapshot") == 1999) & (F.col("variable") == "V4"))).select("snapshot", "variable", "ncol", "value")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(member, label, e array<double>)."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("member"), "label", F.col("embedding").cast("array<double>").alias("e"))


def params(spark: SparkSession, d: str) -> DataFrame:
    """(member, param 0..18, value)."""
    return vectors(spark, d).select("member", F.posexplode(F.slice("e", 1, N_PARAMS)).alias("param", "value"))


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """(level, member, variable 0..3, feat_idx 0..10, value) on three nested levels."""
    e = vectors(spark, d).select("member", "e", F.posexplode(F.slice("e", 21, 4 * N_FEAT)).alias("k", "x"))
    e = e.select("member", F.floor(F.col("k") / N_FEAT).cast("int").alias("variable"), (F.col("k") % N_FEAT).cast("int").alias("feat_idx"), "x", "e")
    y0 = F.col("x") + F.get("e", F.col("feat_idx") % N_PARAMS) * 2.0
    e = e.select("member", "variable", "feat_idx", y0.alias("y0"), F.get("e", F.lit(0)).alias("p0"), F.get("e", F.lit(1)).alias("p1"))
    y1 = F.col("y0") * 1.1 + F.col("p0") * 0.05
    levels = F.array(F.struct(F.lit(0).alias("level"), F.col("y0").alias("value")),
                     F.when(F.col("member") % 4 == 0, F.struct(F.lit(1).alias("level"), y1.alias("value"))),
                     F.when(F.col("member") % 12 == 0, F.struct(F.lit(2).alias("level"), (y1 * 1.05 - F.col("p1") * 0.02).alias("value"))))
    return e.select("member", "variable", "feat_idx", F.inline(F.array_compact(levels))).select("level", "member", "variable", "feat_idx", "value")


def observed(spark: SparkSession, d: str) -> DataFrame:
    """(variable, feat_idx, obs): the first member's outputs and a tenth."""
    return outputs(spark, d).where("level = 0 and member = 0").select("variable", "feat_idx", (F.col("value") + 0.1).alias("obs"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(cand_id, variable, feat_idx, mean, var): 44 rows for each candidate."""
    e = vectors(spark, d).select(F.col("member").alias("cand_id"), F.posexplode(F.slice("e", 20, 4 * N_FEAT)).alias("k", "mean"))
    return e.select("cand_id", F.floor(F.col("k") / N_FEAT).cast("int").alias("variable"), (F.col("k") % N_FEAT).cast("int").alias("feat_idx"), "mean", (F.col("mean") * F.col("mean") + 0.05).alias("var"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """(start_idx, seed, x array<double>, cost) of a multi-start search."""
    x = vectors(spark, d).select(F.col("member").alias("start_idx"), F.col("label").alias("seed"), F.slice("e", 1, N_PARAMS).alias("x"))
    return x.withColumn("cost", F.aggregate("x", F.lit(-1.0), lambda a, v: a + v * v))


def map_weights(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, s): a sparse remapping matrix."""
    q = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("q"))
    total = q.groupBy("row").agg(F.sum("q").alias("t"))
    return q.join(total, "row").select("row", "col", (F.col("q") / F.col("t")).alias("s"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot, member, path): one row for each file of a member in a year."""
    rows = read(spark, d, "lineitem").select(F.year("l_shipdate").alias("snapshot"), F.col("l_suppkey").alias("member"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).distinct()
    return rows.select("snapshot", "member", F.concat(F.lit("h0."), F.col("month"), F.lit(".nc")).alias("path"))


def calibration_rounds(spark: SparkSession, d: str) -> DataFrame:
    """(round, variable, block, sigma)."""
    return read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("round"), F.col("l_returnflag").alias("variable"), F.col("l_linestatus").alias("block")).agg((F.avg("l_tax") + 0.1).alias("sigma"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """(ncol, day, product, value): a daily series by cell, for two products."""
    e = read(spark, d, "events").where(F.col("value").isNotNull())
    return e.groupBy(F.col("user_id").alias("ncol"), F.to_date("ts").alias("day"), F.col("event_type").alias("product")).agg(F.avg("value").alias("value"))


#: The same tables for the oracles, in order of dependence.
CTES: dict[str, str] = {
    "grid": "SELECT p_partkey AS ncol, (((p_partkey * 37) % 1000) + 0.5e0) / 1000e0 * 180e0 - 90e0 AS lat, CAST((p_partkey * 53) % 360 AS DOUBLE) AS lon, CAST(p_size AS DOUBLE) AS area FROM part",
    "region_mask": "SELECT p_partkey AS ncol, p_type AS region FROM part UNION ALL SELECT p_partkey, 'OVERLAP' FROM part WHERE p_size > 25",
    "monthly_wide": "SELECT l_suppkey AS member, l_partkey AS ncol, date_trunc('month', l_shipdate) AS ts, year(l_shipdate) AS snapshot, avg(l_extendedprice) AS V1, avg(l_quantity) AS V2, avg(l_extendedprice * l_discount) AS V3, avg(l_extendedprice * (1e0 - l_discount)) AS V4 FROM lineitem GROUP BY ALL",
    "monthly": "SELECT member, ncol, ts, snapshot, variable, value FROM monthly_wide UNPIVOT (value FOR variable IN (V1, V2, V3, V4))",
    "field": "SELECT member, snapshot, variable, ncol, sum(value * day(last_day(ts))) / sum(day(last_day(ts))) AS value FROM monthly WHERE snapshot IN (1996, 1999) GROUP BY ALL",
    "obs_wide": "SELECT l_partkey AS ncol, avg(l_extendedprice) AS V1, avg(l_quantity) AS V2, avg(l_extendedprice * l_discount) AS V3, avg(l_extendedprice * (1e0 - l_discount)) AS V4 FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL",
    "obs_field": "SELECT s AS snapshot, variable, ncol, CASE WHEN ncol % 7 <> 0 THEN value END AS value FROM (SELECT * FROM obs_wide UNPIVOT (value FOR variable IN (V1, V2, V3, V4))), (SELECT unnest([1996, 1999]) AS s) WHERE NOT (s = 1999 AND variable = 'V4')",
    "vectors": "SELECT vec_id AS member, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings",
    "params": "SELECT member, k AS param, e[k + 1] AS value FROM vectors, (SELECT unnest(range(19)) AS k)",
    "y0": "SELECT member, CAST(k // 11 AS INTEGER) AS variable, CAST(k % 11 AS INTEGER) AS feat_idx, e[21 + k] + e[(k % 11) % 19 + 1] * 2e0 AS y, e[1] AS p0, e[2] AS p1 FROM vectors, (SELECT unnest(range(44)) AS k)",
    "outputs": "SELECT 0 AS level, member, variable, feat_idx, y AS value FROM y0 UNION ALL SELECT 1, member, variable, feat_idx, y * 1.1e0 + p0 * 0.05e0 FROM y0 WHERE member % 4 = 0 UNION ALL SELECT 2, member, variable, feat_idx, (y * 1.1e0 + p0 * 0.05e0) * 1.05e0 - p1 * 0.02e0 FROM y0 WHERE member % 12 = 0",
    "observed": "SELECT variable, feat_idx, y + 0.1e0 AS obs FROM y0 WHERE member = 0",
    "predictions": "SELECT member AS cand_id, CAST(k // 11 AS INTEGER) AS variable, CAST(k % 11 AS INTEGER) AS feat_idx, e[20 + k] AS mean, e[20 + k] * e[20 + k] + 0.05e0 AS var FROM vectors, (SELECT unnest(range(44)) AS k)",
    "results": "SELECT member AS start_idx, label AS seed, e[1:19] AS x, list_sum(list_transform(e[1:19], lambda v: v * v)) - 1e0 AS cost FROM vectors",
    "map_weights": "SELECT l_suppkey AS row, l_partkey AS col, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey) AS s FROM lineitem GROUP BY l_suppkey, l_partkey",
    "manifest": "SELECT DISTINCT year(l_shipdate) AS snapshot, l_suppkey AS member, 'h0.' || strftime(l_shipdate, '%Y-%m') || '.nc' AS path FROM lineitem",
    "calibration_rounds": "SELECT l_linenumber AS round, l_returnflag AS variable, l_linestatus AS block, avg(l_tax) + 0.1e0 AS sigma FROM lineitem GROUP BY ALL",
    "daily": "SELECT user_id AS ncol, CAST(ts AS DATE) AS day, event_type AS product, avg(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "cost_blocks": "SELECT cand_id, variable, feat_idx, CASE WHEN feat_idx < 7 THEN 'zonal' WHEN feat_idx < 10 THEN 'regional' ELSE 'global' END AS block, mean, var, obs FROM predictions JOIN observed USING (variable, feat_idx)",
}


def sql(body: str, *more: str) -> str:
    """The body after the CTEs that it names; more: further CTEs as 'name AS (...)'."""
    import re

    text = " ".join([body, *more])
    used: list[str] = []
    for name in reversed(CTES):
        if re.search(rf"\b{name}\b", text + " ".join(CTES[x] for x in used)):
            used.append(name)
    ctes = [f"{n} AS ({CTES[n]})" for n in reversed(used)] + list(more)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
