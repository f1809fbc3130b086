"""Exact nearest points by distances to a few pivots, without a look at every pair.

Pivots are training points. The distance of two points is at least |d(x, p) - d(y, p)| for every pivot p.
A point first looks at the training points in its own ring for an upper bound, then at the rings whose distances to
every pivot reach into it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.lineage import settled

#: Rings there are at most, about, and rows that move together.
RINGS, PACK = 24, 4096


@dataclass
class Pivots:
    """A bounded number of training points, all on the driver."""

    ids: list[int]
    points: np.ndarray
    far: float  # scale of the pivots, for rounding

    @classmethod
    def choose(cls, training: DataFrame, count: int, seed: int) -> Pivots | None:
        """`count` training points by a hash of their id; those in the flat of earlier ones are left out."""
        rows = training.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count).collect()
        if not rows:
            return None
        ids, points = [rows[0]["id"]], [np.array(rows[0]["x"], dtype=float)]
        basis: list[np.ndarray] = []
        for r in rows[1:]:
            v = np.array(r["x"], dtype=float) - points[0]
            rest = v - sum(((v @ q) * q for q in basis), np.zeros_like(v))
            if np.linalg.norm(rest) > 1e-3 * max(np.linalg.norm(v), 1e-12):
                ids.append(r["id"])
                points.append(v + points[0])
                basis.append(rest / np.linalg.norm(rest))
        edges = np.array(points)[1:] - points[0]
        return cls(ids, np.array(points), float(np.sqrt(max((edges * edges).sum(1), default=0.0))))

    def placed(self, df: DataFrame) -> DataFrame:
        """df with _d, distances to the pivots."""
        return df.withColumn("_d", F.array(*(distance(F.col("x"), F.array(*(F.lit(float(v)) for v in p))) for p in self.points)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _measured(at: Pivots, exclude_self: bool, sieve: bool):
    """For mapInArrow over (q array<(id, x, limit)>, t array<(id, x)>): (id, nearest, dist, n) for the points that have something to measure.

    Products of matrices give all distances up to rounding; those that may be least are computed from the differences.
    sieve: only points whose limit reaches between the training points' distances to every pivot.
    """

    def plain(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        v = rows.values
        ids = v.field("id").to_numpy(zero_copy_only=False)
        return ids, v.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), v

    def run(batches):
        for batch in batches:
            for q_row, t_row in zip(batch.column("q"), batch.column("t"), strict=True):
                ids, x, q = plain(q_row)
                own, y, _ = plain(t_row)
                order = np.argsort(own, kind="stable")
                own, y = own[order], y[order]
                if sieve:
                    limit = q.field("limit").to_numpy(zero_copy_only=False)
                    keep = np.ones(len(ids), dtype=bool)
                    for p in at.points:
                        d, e = np.sqrt(((x - p) ** 2).sum(1)), np.sqrt(((y - p) ** 2).sum(1))
                        keep &= ~((e.min() - d > limit) | (d - e.max() > limit))
                    ids, x = ids[keep], x[keep]
                yy = (y * y).sum(1)
                step = max(1, 2_000_000 // max(1, len(y)))
                found = []
                for i in range(0, len(ids), step):
                    a, k = x[i:i + step], ids[i:i + step]
                    aa = (a * a).sum(1)
                    d2 = aa[:, None] + yy[None, :] - 2 * (a @ y.T)
                    n = np.full(len(k), len(own))
                    if exclude_self:
                        lo, hi = np.searchsorted(own, k, "left"), np.searchsorted(own, k, "right")
                        n -= hi - lo
                        for r in np.flatnonzero(hi > lo):
                            d2[r, lo[r]:hi[r]] = np.inf
                    d2[np.isnan(d2)] = np.inf
                    near = d2 <= (d2.min(1) + 1e-9 * (aa + yy.max()))[:, None]
                    near &= ~np.isinf(d2) | np.isinf(d2.min(1))[:, None]
                    if exclude_self:
                        for r in np.flatnonzero(hi > lo):
                            near[r, lo[r]:hi[r]] = False
                    r, c = np.nonzero(near)
                    d = np.sqrt(((a[r] - y[c]) ** 2).sum(1))
                    # Rows in order, then distance, then the smallest id: the first of a row is its nearest.
                    best = np.lexsort((own[c], d, r))
                    first = best[np.unique(r[best], return_index=True)[1]]
                    found.append((k[r[first]], own[c[first]], d[first], n[r[first]]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found, strict=True)], names=["id", "nearest", "dist", "n"])

    return run


def nearest_neighbor(points: DataFrame, training: DataFrame, exclude_self: bool = False, pivots: int = 24, ring_size: int = 32, seed: int = 0) -> DataFrame:
    """(id, nearest, dist, examined): Euclidean distance of each point (id, x) to the nearest training point; ties go to the smallest id.

    exclude_self leaves out training points of the point's own id. Points without a complete x, and all points where
    there is no training point, get nulls. examined counts the training points whose distance was measured.
    pivots: at most so many training points come to the driver; rings hold about ring_size training points, more
    where there would be more than RINGS of them. Points and training points move in packs, a pack of points once
    for each ring that it reaches.
    """
    whole = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull())
    good = training.where(whole).select("id", "x")
    at = Pivots.choose(good, pivots, seed)
    none = points.select("id", F.lit(None).cast("bigint").alias("nearest"), F.lit(None).cast("double").alias("dist"), F.lit(0).cast("long").alias("examined"))
    if at is None:
        return none
    k = len(at.ids)
    home = (F.array_position("_d", F.array_min("_d")) - 1).cast("int")
    t = settled(at.placed(good).select("id", "x", "_d", home.alias("cell"), F.array_min("_d").alias("r")))
    # One row for each pivot: how many points it has and between which distances.
    cells = {r["cell"]: r for r in t.groupBy("cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    lo, hi = (F.array(*(F.lit(float(cells[c][e])) if c in cells else F.lit(0.0) for c in range(k))) for e in ("lo", "hi"))
    size = max(ring_size, sum(c["n"] for c in cells.values()) // RINGS)
    rings = F.array(*(F.lit(max(1, cells[c]["n"] // size) if c in cells else 1) for c in range(k)))

    def ring(c: Column, r: Column) -> Column:
        """The ring of cell c at distance r from its pivot; inside and outside the cell, its first and last."""
        wide = F.when(F.get(hi, c) > F.get(lo, c), F.get(hi, c) - F.get(lo, c)).otherwise(1.0)
        n = F.get(rings, c)
        return F.least(F.greatest(F.floor((r - F.get(lo, c)) / wide * n), F.lit(0)), n - 1).cast("int")

    def packed(df: DataFrame, name: str, columns: list[str], *more: Column) -> DataFrame:
        """Packs of a ring, of about PACK rows each, with the distances to each pivot that they lie between."""
        n = df.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs"))
        df = df.join(n, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("packs")))
        ends = [F.array(*(f(F.get("_d", F.lit(j))) for j in range(k))).alias(f"{name}_{e}") for e, f in (("lo", F.min), ("hi", F.max))]
        rows = df.groupBy("cell", "ring", "part").agg(F.collect_list(F.struct(*columns)).alias(name), *ends, *more)
        return settled(rows.withColumn(f"{name}_pack", F.xxhash64("cell", "ring", "part")))

    t = packed(t.withColumn("ring", ring(F.col("cell"), F.col("r"))), "t", ["id", "x"])
    q = at.placed(points.where(whole).select("id", "x"))
    own = F.array(*(F.lit(i) for i in at.ids))
    to_pivots = F.array_min(F.zip_with("_d", own, lambda d, i: F.when(i != F.col("id"), d)) if exclude_self else F.col("_d"))
    q = q.withColumns({"limit": F.coalesce(to_pivots, F.lit(float("inf"))), "cell": home}).withColumn("ring", ring(F.col("cell"), F.array_min("_d")))
    q = settled(q.select("id", "x", "_d", "limit", "cell", "ring"))
    result = "id bigint, nearest bigint, dist double, n bigint"

    # A first bound from the point's own ring.
    mine = packed(q, "q", ["id", "x", "limit"])
    first = mine.select("cell", "ring", "q").join(t.select("cell", "ring", "t"), ["cell", "ring"]).select("q", "t").mapInArrow(_measured(at, exclude_self, False), result)
    first = settled(first)
    bound = first.groupBy("id").agg(F.min("dist").alias("near"))
    # A bound holds up to rounding.
    slack = 1e-6 * max(at.far, 1e-30)
    q = q.join(bound, "id", "left").withColumn("limit", F.least("limit", "near") + slack + 1e-6 * F.get("_d", F.lit(0)))
    q = packed(q, "q", ["id", "x", "limit"], F.max("limit").alias("most"))

    # Packs of the other rings that reach into the bound of a pack; there, each point by its own bound.
    slim = t.select("t_pack", F.col("cell").alias("t_cell"), F.col("ring").alias("t_ring"), "t_lo", "t_hi")
    reach = F.forall(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (F.get("q_lo", j) - F.col("most") <= F.get("t_hi", j)) & (F.get("q_hi", j) + F.col("most") >= F.get("t_lo", j)))
    pairs = q.select("q_pack", "cell", "ring", "q_lo", "q_hi", "most").join(slim, ((F.col("cell") != F.col("t_cell")) | (F.col("ring") != F.col("t_ring"))) & reach).select("q_pack", "t_pack")
    pairs = settled(pairs)
    others = pairs.join(q.select("q_pack", "q"), "q_pack").join(t.select("t_pack", "t"), "t_pack").select("q", "t").mapInArrow(_measured(at, exclude_self, True), result)
    best = first.unionByName(others).groupBy("id").agg(F.min(F.struct("dist", "nearest")).alias("m"), F.sum("n").alias("examined"))
    return points.select("id").join(best, "id", "left").select("id", "m.nearest", "m.dist", F.coalesce("examined", F.lit(0)).alias("examined"))
