"""Zonal, regional and global means, and the clean-up of the features they make.

Every mean is one weighted aggregate under some grouping; all three blocks come from one scan
and one shuffle, in which each cell is exploded into the places it belongs to and partial sums
are made before rows move, so that the global group is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.columns import band_centre, lat_band, weighted_mean, weighted_mean_all

KEYS = ["member", "snapshot", "variable"]


def wmean_valid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Area-weighted mean of present values; cells: keys, value, area."""
    return cells.groupBy(*keys).agg(weighted_mean(F.col("value"), F.col("area")).alias("value"))


def wmean_legacy(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Older mean: the area of missing cells stays in the denominator."""
    return cells.groupBy(*keys).agg(weighted_mean_all(F.col("value"), F.col("area")).alias("value"))


def zonal_mean(field: DataFrame, grid: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    cells = field.join(grid, "ncol").withColumn("band", lat_band(F.col("lat")))
    return wmean_valid(cells.where("band is not null"), [*keys, "band"])


def zonal_mean_legacy(field: DataFrame, grid: DataFrame, keys: list[str] = KEYS, width: float = 10.0) -> DataFrame:
    """Older bands, open on both sides: a cell on an edge is in none."""
    inside = (F.col("lat") + 90.0) % width != 0
    cells = field.join(grid, "ncol").where(inside).withColumn("band", lat_band(F.col("lat"), width))
    return wmean_legacy(cells.where("band is not null"), [*keys, "band"])


def zonal_mean_dlat(field: DataFrame, grid: DataFrame, keys: list[str], lat1: float, lat2: float, dlat: float) -> DataFrame:
    """Bins centred on lat1, lat1 + dlat ... lat2, half open; with cell counts, empty bins as missing."""
    n = round((lat2 - lat1) / dlat) + 1
    centre = F.sequence(F.lit(0), F.lit(n - 1))
    cells = field.join(grid, "ncol").withColumn("bin", F.floor((F.col("lat") - lat1 + dlat / 2) / dlat).cast("int"))
    found = cells.where((F.col("bin") >= 0) & (F.col("bin") < n)).groupBy(*keys, "bin").agg(
        weighted_mean(F.col("value"), F.col("area")).alias("value"), F.count("value").alias("n_cells"))
    every = field.select(*keys).distinct().select(*keys, F.explode(centre).alias("bin"))
    out = every.join(found, [*keys, "bin"], "left")
    return out.select(*keys, (F.col("bin") * dlat + lat1).alias("lat"), "value", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


def regional_mean(field: DataFrame, grid: DataFrame, regions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A cell counts in every region that it is in."""
    cells = field.join(grid, "ncol").join(regions, "ncol")
    return wmean_valid(cells, [*keys, "region"])


def global_mean(field: DataFrame, grid: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return wmean_valid(field.join(grid, "ncol"), keys)


def region_area_weights(grid: DataFrame, regions: DataFrame, land: DataFrame) -> DataFrame:
    """Area of each region, and the part of it over cells that are at most half land; land: (ncol, land)."""
    cells = regions.join(grid, "ncol").join(land, "ncol", "left")
    return cells.groupBy("region").agg(F.sum("area").alias("area"), F.sum(F.when(1.0 - F.col("land") >= 0.5, F.col("area"))).alias("ocean_area"))


def zrg_all(field: DataFrame, grid: DataFrame, regions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, block, loc, value): all three blocks in one pass.

    Cells in no band or region still count globally. grid and regions are broadcast only below the
    engine's own size limit.
    """
    inside = regions.groupBy("ncol").agg(F.collect_set("region").alias("regions"))
    places = grid.join(inside, "ncol", "left").select("ncol", "area", F.array_compact(F.concat(
        F.array(F.struct(F.lit("global").alias("block"), F.lit("global").alias("loc")),
                F.when(lat_band(F.col("lat")).isNotNull(), F.struct(F.lit("zonal").alias("block"), band_centre(lat_band(F.col("lat"))).cast("string").alias("loc")))),
        F.transform(F.coalesce("regions", F.array().cast("array<string>")), lambda r: F.struct(F.lit("regional").alias("block"), r.alias("loc"))))).alias("at"))
    cells = field.join(places, "ncol").select(*keys, "value", "area", F.inline("at"))
    return wmean_valid(cells, [*keys, "block", "loc"])


def zrg_wide(zrg: DataFrame, features: list[str], keys: list[str], feature: str = "feature") -> DataFrame:
    """Long to wide in the order of features; unpivot takes it back."""
    return zrg.groupBy(*keys).pivot(feature, features).agg(F.first("value"))


def zrg_long(wide: DataFrame, features: list[str], keys: list[str], feature: str = "feature") -> DataFrame:
    return wide.unpivot(keys, features, feature, "value")


def snapshot_merge(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The first table's values, and where it has none the second's."""
    a, b = first.select(*keys, F.col("value").alias("_a")), second.select(*keys, F.col("value").alias("_b"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("_a", "_b").alias("value"))


def drop_nan_features(zrg: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """(feat_idx): positions that stay.

    A position goes if it is missing for all members in some snapshot and variable, or in the
    observations; then it goes for every snapshot and variable.
    """
    gone = zrg.groupBy("feat_idx", "snapshot", "variable").agg(F.count("value").alias("n")).where("n = 0").select("feat_idx")
    if obs is not None:
        gone = gone.unionByName(obs.where("value is null").select("feat_idx"))
    return zrg.select("feat_idx").distinct().join(gone.distinct(), "feat_idx", "left_anti")


def drop_bands_explicit(bands: DataFrame, requested: list[float]) -> DataFrame:
    """Bands without those whose centre is nearest to a requested latitude; bands: (band, centre)."""
    wanted = bands.sparkSession.createDataFrame([(float(x),) for x in requested], "lat double")
    gone = wanted.crossJoin(F.broadcast(bands)).groupBy("lat").agg(F.min_by("band", F.struct(F.abs(F.col("centre") - F.col("lat")), F.col("band"))).alias("band"))
    return bands.join(gone.select("band").distinct(), "band", "left_anti")


def apply_feature_mask(zrg: DataFrame, mask: DataFrame) -> DataFrame:
    return zrg.join(F.broadcast(mask.where("keep").select("feat_idx")), "feat_idx", "left_semi")


def feature_mask(all_features: DataFrame, kept: DataFrame) -> DataFrame:
    """(feat_idx, keep)."""
    k = kept.select("feat_idx", F.lit(True).alias("keep"))
    return all_features.select("feat_idx").distinct().join(k, "feat_idx", "left").select("feat_idx", F.coalesce("keep", F.lit(False)).alias("keep"))


def align_levels(low: DataFrame, low_mask: DataFrame, high_mask: DataFrame) -> DataFrame:
    """A lower level's rows in the top level's layout; features that it lacks are NULL.

    low: (member, variable, pos, value) with pos counted among its kept features.
    """
    if low_mask.count() != high_mask.count():
        raise ValueError("the levels have different base layouts")

    def positions(mask: DataFrame, name: str) -> DataFrame:
        return mask.where("keep").select("feat_idx", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("feat_idx")) - 1).alias(name))

    lo, hi = positions(low_mask, "pos"), positions(high_mask, "top")
    rows = low.join(F.broadcast(lo), "pos").select("member", "variable", "feat_idx", "value")
    every = low.select("member", "variable").distinct().crossJoin(F.broadcast(hi))
    return every.join(rows, ["member", "variable", "feat_idx"], "left").select("member", "variable", F.col("top").alias("pos"), "value")


def remap_feature_order(source_mask: DataFrame, target_mask: DataFrame) -> DataFrame:
    """(target_pos, source_pos); a target feature that the source lacks is an error when read: source_pos is NULL."""
    w = Window.partitionBy(F.lit(1)).orderBy("feat_idx")
    s = source_mask.where("keep").select("feat_idx", (F.row_number().over(w) - 1).alias("source_pos"))
    t = target_mask.where("keep").select("feat_idx", (F.row_number().over(w) - 1).alias("target_pos"))
    return t.join(s, "feat_idx", "left").select("target_pos", "source_pos")


def ensemble_spread(zrg: DataFrame, keys: list[str]) -> DataFrame:
    v = F.col("value")
    return zrg.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.median(v).alias("median"))


def feature_labels(spark, snapshots: list, regions: list[str], width: float = 10.0) -> DataFrame:
    """(feat_idx, snapshot, block, loc) for all snapshots, in layout order."""
    n = round(180 / width)
    places = [("zonal", str(-90 + width / 2 + i * width)) for i in range(n)] + [("regional", r) for r in regions] + [("global", "global")]
    one = F.array(*(F.struct(F.lit(b).alias("block"), F.lit(loc).alias("loc")) for b, loc in places))
    snaps = F.array(*map(F.lit, snapshots))
    rows = spark.range(1).select(F.posexplode(snaps).alias("s", "snapshot")).select("s", "snapshot", F.posexplode(one).alias("i", "x"))
    return rows.select((F.col("s") * len(places) + F.col("i")).alias("feat_idx"), "snapshot", "x.block", "x.loc")


def block_of(pos, n_zonal: int, n_regions: int, n_global: int = 1):
    """Block of a flat feature position, pooled over snapshots."""
    at = pos % (n_zonal + n_regions + n_global)
    return F.when(at < n_zonal, "zonal").when(at < n_zonal + n_regions, "regional").otherwise("global")


def split_obs_blocks(rows: DataFrame, values: str, n_feat: int) -> DataFrame:
    """A flat observation row as (variable, feat_idx, value)."""
    out = rows.select(F.posexplode(values).alias("k", "value"))
    return out.select(F.floor(F.col("k") / n_feat).cast("int").alias("variable"), (F.col("k") % n_feat).alias("feat_idx"), "value")
